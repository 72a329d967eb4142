"""Translations: which files are versions of one page, and whether they still have its structure."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid import ship
from quillgrid.functions.dialect import compiled
from quillgrid.functions.segment import BLANKS, Document

# Languages, and the layouts in the order in which they are tried.
LANGUAGES = "en es fr de pt it ja ko zh ru ar ur hi bn pa te ta mr gu kn ml nl pl tr vi th id sv da no fi cs el he ro hu uk fa sw af sr hr sk bg lt lv et sl ms tl ne si km my ka az kk uz".split()
LAYOUTS = ("hugo", "docusaurus", "dir", "suffix")
LOCALE = rf"(?i)^(?:{'|'.join(LANGUAGES)})(?:[-_][a-z0-9]{{2,4}})?\z"
FENCE = compiled(r"(^|\r?\n)(```|~~~)[^\n]*\r?\n([\s\S]*?)\r?\n\2")


def locale(token: Column) -> Column:
    return F.when(token.rlike(LOCALE), F.lower(token))


def suffix_key(path: Column, default: str) -> Column:
    """name.<locale>.ext beside name.ext."""
    inner = F.regexp_extract(path, r"^(?:.*/)?[^/]+?\.([A-Za-z0-9-]{2,7})\.[^./]+\z", 1)
    named = locale(inner)
    source = F.when(named.isNotNull(), F.regexp_replace(path, r"\.[A-Za-z0-9-]{2,7}(\.[^./]+)\z", "$1")).otherwise(path)
    return F.when(path.rlike(r"[^/]\.[^./]+\z"), F.struct(F.lit("suffix").alias("layout"), source.alias("source"), F.coalesce(named, F.lit(default)).alias("locale")))


def hugo_key(path: Column, default: str) -> Column:
    """content.<locale>/ beside content/."""
    seg = r"(?i)^((?:.*?/)?)content(?:[.-]([a-z]{2,3}(?:[-_][a-z0-9]{2,4})?))?/(.+)\z"
    token = F.regexp_extract(path, seg, 2)
    found = F.when(token == "", F.lit(default)).otherwise(locale(token))
    return F.when(path.rlike(seg) & found.isNotNull(), F.struct(F.lit("hugo").alias("layout"), F.concat(F.regexp_extract(path, seg, 1), F.lit("content/"), F.regexp_extract(path, seg, 3)).alias("source"), found.alias("locale")))


def docusaurus_key(path: Column, default: str) -> Column:
    """i18n/<locale>/docusaurus-plugin-content-<folder>/current/ beside docs/ or blog/."""
    moved = r"^((?:.*?/)?)i18n/([A-Za-z0-9-]+)/docusaurus-plugin-content-(docs|blog|pages)/(?:current/)?(.+)\z"
    token = locale(F.regexp_extract(path, moved, 2))
    there = F.struct(F.lit("docusaurus").alias("layout"), F.concat(F.regexp_extract(path, moved, 1), F.regexp_extract(path, moved, 3), F.lit("/"), F.regexp_extract(path, moved, 4)).alias("source"), token.alias("locale"))
    home = F.struct(F.lit("docusaurus").alias("layout"), path.alias("source"), F.lit(default).alias("locale"))
    return F.when(path.rlike(moved) & token.isNotNull(), there).when(path.rlike(r"^(?:.*?/)?(?:docs|blog)/.+\z"), home)


def dir_key(path: Column, default: str) -> Column:
    """A folder named by a locale: the first one."""
    parts = F.split(path, "/")
    at = F.get(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda k: F.element_at(parts, k).rlike(LOCALE)), F.lit(0))
    source = F.array_join(F.transform(parts, lambda p, k: F.when(k + 1 == at, F.lit(default)).otherwise(p)), "/")
    return F.when((F.size(parts) > 1) & at.isNotNull(), F.struct(F.lit("dir").alias("layout"), source.alias("source"), F.lower(F.get(parts, at - 1)).alias("locale")))


KEYS = {"suffix": suffix_key, "hugo": hugo_key, "docusaurus": docusaurus_key, "dir": dir_key}


def mirror_key(path: Column, default: str, source: str, translation: str) -> Column:
    """A layout of one's own: source, and translation with {locale} in it."""
    head, tail = translation.rstrip("/").split("{locale}")
    pattern = "^" + re.escape(head) + r"([A-Za-z0-9-]+)" + re.escape(tail) + r"/(.+)\z"
    here = "^" + re.escape(source.rstrip("/")) + r"/(.+)\z"
    key = lambda rest, loc: F.struct(F.lit("mirror").alias("layout"), F.concat(F.lit(source.rstrip("/") + "/"), rest).alias("source"), loc.alias("locale"))
    return F.when(path.rlike(here), key(F.regexp_extract(path, here, 1), F.lit(default))).when(path.rlike(pattern), key(F.regexp_extract(path, pattern, 2), F.lower(F.regexp_extract(path, pattern, 1))))


def sets(paths: DataFrame, default: str = "en", layouts: tuple[str, ...] = LAYOUTS, mirrors: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """path, layout, locale, is_source, source, siblings (locale, path; the source first) of the files that have versions: each path gets a key for each layout, files of one key are versions, and the first layout with any wins."""
    keys = [mirror_key(F.col("path"), default, *m) for m in mirrors] + [KEYS[x](F.col("path"), default) for x in layouts]
    rows = paths.select("path", F.posexplode(F.array(*keys)).alias("pos", "k")).filter("k IS NOT NULL").select("path", "pos", "k.*")
    versions = F.collect_set(F.struct(F.col("locale"), F.col("path")))
    groups = rows.groupBy("pos", "source").agg(versions.alias("all")).filter("size(all) > 1")
    met = rows.join(groups, ["pos", "source"])
    others = F.filter("all", lambda s: (s["path"] != F.col("path")) & (s["locale"] != F.col("locale")))
    rank = F.array_sort(F.transform(others, lambda s: F.struct((s["path"] != F.col("source")).alias("later"), s["locale"].alias("locale"), s["path"].alias("path"))))
    met = met.withColumn("siblings", F.transform(rank, lambda s: F.struct(s["locale"].alias("locale"), s["path"].alias("path")))).filter("size(siblings) > 0")
    best = met.groupBy("path").agg(F.min_by(F.struct("layout", "locale", (F.col("source") == F.col("path")).alias("is_source"), "source", "siblings"), "pos").alias("b"))
    return best.select("path", "b.*")


def skeleton(text: str) -> dict:
    doc = Document(text)
    return {
        "levels": [h.level for h in doc.headings],
        "code": [m[3].strip(BLANKS) for m in FENCE.finditer(text)],
        "links": sorted(x.target for x in doc.links if re.match("https?:", x.target, re.I)),
        "images": sorted(x.target for x in doc.images),
    }


SKELETON = "struct<levels:array<int>,code:array<string>,links:array<string>,images:array<string>>"


def _skeletons(texts: pa.Array) -> pa.Array:
    words = pa.list_(pa.string())
    return pa.array([skeleton(t or "") for t in texts.to_pylist()], pa.struct([("levels", pa.list_(pa.int32())), ("code", words), ("links", words), ("images", words)]))


def drift(a: Column, b: Column) -> Column:
    """What b lacks of the structure of a: array of (severity, what, source, here)."""
    say = lambda when, severity, what, x, y: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(what).alias("what"), x.cast("int").alias("source"), y.cast("int").alias("here")))
    size = lambda c, name: F.size(c[name])
    more = lambda name: size(a, name) != size(b, name)
    other = F.size(F.filter(F.zip_with(a["code"], b["code"], lambda x, y: x != y), lambda x: x))
    gone = F.size(F.filter(a["links"], lambda x: ~F.array_contains(b["links"], x)))
    found = F.array(
        say(more("levels"), "warn", "headings", size(a, "levels"), size(b, "levels")),
        say(~more("levels") & (a["levels"] != b["levels"]), "warn", "nesting", size(a, "levels"), size(b, "levels")),
        say(more("code"), "warn", "code blocks", size(a, "code"), size(b, "code")),
        say(~more("code") & (other > 0), "advisory", "code", other, F.lit(0)),
        say(gone > 0, "advisory", "links", gone, F.lit(0)),
        say(more("images"), "advisory", "images", size(a, "images"), size(b, "images")),
    )
    return F.filter(found, lambda x: x.isNotNull())


def conform(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """source, path, drift of pairs (source, path) of files (path, text)."""
    ship(files.sparkSession)
    read = F.arrow_udf(_skeletons, SKELETON)
    shape = files.select("path", read("text").alias("s"))
    rows = pairs.join(shape.withColumnsRenamed({"path": "source", "s": "a"}), "source").join(shape.withColumnRenamed("s", "b"), "path")
    return rows.select("source", "path", drift(F.col("a"), F.col("b")).alias("drift"))


def sweep(files: DataFrame, **how) -> DataFrame:
    """Drift of every translation against its source, the worst first."""
    found = sets(files.select("path"), **how).filter("is_source")
    pairs = found.select(F.col("path").alias("source"), F.explode("siblings.path").alias("path"))
    out = conform(files, pairs).filter("size(drift) > 0")
    weight = F.aggregate("drift", F.lit(0), lambda s, d: s + F.when(d["what"].isin("headings", "code blocks", "images"), F.abs(d["source"] - d["here"])).otherwise(F.lit(1)))
    return out.withColumn("weight", weight).orderBy(F.desc("weight"), "source", "path")
