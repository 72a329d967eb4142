"""Trees of files as tables, tables as files, and reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions.config import matches
from quillgrid.operators import detect, score

# Prose, folders and names that are passed over, and languages of translations.
PROSE = r"(?i)\.(md|mdx|mdc|markdown)\z"
SKIPPED = "node_modules .git dist build .next coverage testdata test-data fixtures __fixtures__ golden snapshots __snapshots__ target out vendor vendored 3rdparty thirdparty third_party third-party".split()
GENERATED = r"(?i)^((CHANGELOG|HISTORY|CHANGES|RELEASES?|NEWS|AUTHORS|CONTRIBUTORS|NOTICE|LICEN[CS]E|COPYING|THIRD[-_]?PARTY)(\.|\z)|llms(-full)?\.txt\z)"
LANGUAGES = "es fr de pt it ja ko zh ru ar ur hi bn pa te ta mr gu kn ml nl pl tr vi th id sv da no fi cs el he ro hu uk fa sw af sr hr sk bg lt lv et sl ms tl ne si km my ka az kk uz".split()
REGIONS = "br cn tw hk mo sg my us gb uk au ca nz ie za in pk bd lk mx ar cl co pe ve ec uy bo py cr pa do gt hn ni sv pr es pt fr be ch lu at de it nl se dk fi is pl cz sk hu ro bg gr cy tr ru ua by il sa ae eg ma dz tn jo lb iq kw qa bh om ye jp kr kp th vn id ph la kh mm np hans hant latn cyrl arab deva hebr thai jpan kore".split()
_L, _R = "|".join(LANGUAGES), "|".join(REGIONS)
TRANSLATED = rf"(?i)\.(?:{_L})(?:-[a-z]{{2,4}})?\.(?:md|mdx|markdown|txt)\z|(?:^|/)content[.-](?:{_L})(?:-(?:{_R}))?(?:/|\z)|(?:^|/)(?:{_L})-(?:{_R})(?:/|\z)|(?:^|/)(?:i18n|locales|translations|lang|locale)/(?:{_L})(?:-[^/]*)?(?:/|\z)"


def texts(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path (below root) and text of the files of a tree, read by Spark from any store."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    whole = F.input_file_name()
    return rows.select(below(whole, root).alias("path"), F.col("value").alias("text"))


def one(spark: SparkSession, text: str, name: str = "<stdin>") -> DataFrame:
    """path, text of a document that is no file, such as what comes by standard input."""
    return spark.createDataFrame([(name, text)], "path string, text string")


def translatable(rows: DataFrame) -> DataFrame:
    """The files (path, ...) that may be versions of a page: markdown, translations too, in no folder that is passed over."""
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda p: p.isin(*SKIPPED) | p.startswith("."))
    return rows.filter(F.col("path").rlike(PROSE) & ~hidden)


def paths(spark: SparkSession, root: str) -> DataFrame:
    """path of every file of a tree; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return rows.select(below(F.col("path"), root).alias("path"))


def below(path: Column, root: str) -> Column:
    tail = re.sub("^[a-z0-9]+:/*", "", root).strip("/")
    return F.regexp_replace(F.regexp_replace(path, "^[a-z0-9]+:/*", ""), r"^/*\Q" + tail + r"\E/*", "")


def skipped(path: Column) -> Column:
    """Folders of builds, data and others' code, hidden ones, and generated files."""
    parts = F.split(path, "/")
    return F.exists(parts, lambda p: p.isin(*SKIPPED) | p.startswith(".")) | F.element_at(parts, -1).rlike(GENERATED)


def translated(path: Column) -> Column:
    """Named as a translation into another language, by file or folder."""
    return path.rlike(TRANSLATED)


def prose(files: DataFrame, ignored: list[str] | None = None) -> DataFrame:
    """The files (path, text) that the detector is for: markdown, not generated, ignored, translated, or a dump of data."""
    rows = files.filter(F.col("path").rlike(PROSE) & ~skipped(F.col("path")) & ~translated(F.col("path")))
    rows = rows.filter(~matches(F.col("path"), ignored)) if ignored else rows
    return rows.filter(~detect.looks_like_data(F.col("text")))


def detected(spark: SparkSession, root: str, settings: detect.Settings = detect.Settings(), ignored: list[str] | None = None) -> DataFrame:
    """Findings of all prose of a tree."""
    return detect.detected(prose(texts(spark, root), ignored), settings, "path")


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """conv_id, turn, role, text of JSON lines."""
    return spark.read.schema("conv_id long, turn long, role string, text string").json(path)


def report(docs: DataFrame, findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, json: one JSON object for each document, with score, band and findings in order."""
    per = findings.groupBy(key).agg(F.collect_list(F.struct(*detect.COLUMNS)).alias("found"))
    # sorted on both sides: what Spark thinks of the size of all findings is no ground to send them to the driver
    out = score.scored(docs, findings, key).join(per.hint("merge"), key, "left")
    return _reported(out.withColumn("found", F.coalesce("found", F.array().cast(per.schema["found"].dataType))), key)


def documents_report(docs: DataFrame, settings: detect.Settings = detect.Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """What report() gives for the findings of detected(), in one pass over the texts and without a shuffle of findings."""
    return _reported(score.listed_scores(detect.listed(docs, settings, key, text), key, text), key)


def _reported(rows: DataFrame, key: str) -> DataFrame:
    """key, json of rows with key, score, band and found."""
    names = ("line", "col", "rule_id", "family", "severity", "span", "message")
    order = F.sort_array(F.transform("found", lambda f: F.struct(detect.rank(f["severity"]).alias("r"), *[f[n].alias(n) for n in names])))
    shown = F.transform(order, lambda f: F.struct(f["rule_id"].alias("rule"), f["family"].alias("family"), f["severity"].alias("severity"), f["line"].alias("line"), f["col"].alias("col"), f["span"].alias("span"), f["message"].alias("message")))
    return rows.select(key, F.to_json(F.struct(F.col(key).alias("file"), "score", "band", shown.alias("findings"))).alias("json"))


def written(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """As Parquet, by partitions of the columns by if any."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


# Endings of files that are text, and names that are tests or builds.
TEXTUAL = r"(?i)\.(md|mdx|mdc|markdown|txt|rst|adoc|js|jsx|mjs|cjs|ts|tsx|py|rb|php|go|rs|java|kt|kts|scala|swift|c|h|cc|cpp|hpp|cs|m|mm|sql|sh|bash|zsh|lua|r|jl|dart|ex|exs|clj|json|yaml|yml|toml|ini|cfg|proto|graphql|tf|hcl)\z"
TESTS = r"(?i)(\.|_|-)(test|spec)\.[a-z]+\z|\.d\.ts\z|\.min\.js\z"
UNINDEXED = "node_modules .git dist build .next out coverage target vendor vendored third_party third-party .venv __pycache__ .idea".split()
LARGEST = 512 * 1024


def textual(rows: DataFrame, largest: int | None = LARGEST) -> DataFrame:
    """The files (path, text) that associations are made of: any text, no tests or builds, and at most so many bytes (None: of any size)."""
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda p: p.isin(*UNINDEXED) | p.startswith("."))
    rows = rows.filter(F.col("path").rlike(TEXTUAL) & ~F.col("path").rlike(TESTS) & ~hidden)
    return rows if largest is None else rows.filter(F.octet_length("text") <= largest)


def shallow(rows: DataFrame, depth: int) -> DataFrame:
    """Paths of at most so many parts."""
    return rows.filter(F.size(F.split("path", "/")) <= depth)


def claims(rows: DataFrame, value: str = "value") -> DataFrame:
    """n, claims of a JSON text: a list of lists, or of objects with i and claims; trimmed, each once whatever its case, at most 8."""
    lists = F.from_json(value, "array<array<string>>")
    objects = F.from_json(value, "array<struct<i:int,claims:array<string>>>")
    labelled = F.coalesce(F.forall(objects, lambda o: o["i"].isNotNull()), F.lit(False))
    each = F.when(labelled, objects).otherwise(F.transform(lists, lambda c, k: F.struct(k.alias("i"), c.alias("claims"))))
    clean = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    out = rows.select(F.inline(each)).select(F.col("i").alias("n"), clean(F.col("claims")).alias("c"))
    once = F.filter("c", lambda x, k: F.array_position(F.transform("c", lambda y: F.lower(y)), F.lower(x)) == k + 1)
    return out.select("n", F.slice(once, 1, 8).alias("claims"))
