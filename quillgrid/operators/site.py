"""A documentation tree: links, anchors, navigation and community files, as joins against the table of paths."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid import ship
from quillgrid.functions.dialect import compiled
from quillgrid.functions.text import resolved
from quillgrid.plans.session import settled

# Shapes of links and headings, and where a link may lead.
FENCED = compiled(r"^(```|~~~)[^\n]*\n[\s\S]*?^\1[^\n]*$", "gm")
INDENTED = compiled(r"(^|\n[ \t]*\n)((?:(?: {4}|\t)[^\n]*\n?)+)")
CODE = compiled(r"`[^`\n]*`")
DEFINITION = compiled(r"^[ \t]*\[([^\]^][^\]]*)\]:\s*(<[^>\n]*>|\S+)", "gm")
INLINE = compiled(r"""!?\[([^\]]*)\]\(\s*(<[^>\n]*>|[^)\s]+)(?:\s+["'][^)\n]*["'])?\s*\)""")
REFERENCE = compiled(r"\[([^\]]+)\]\[([^\]]*)\]")
ATX = compiled(r"^#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*$", "gm")
CUSTOM = compiled(r"\{#([^}\s]+)\}\s*$")
NAMED = compiled(r"""<(?:a|h[1-6]|div|span|section)\s[^>]*(?:name|id)=["']([^"']+)["']""", "i")
PUNCTUATION = """[!(),.:;'"`’“”?\\[\\]{}\\\\/|@#$%^&*+=~<>]+"""
EXTERNAL = "(?i)^([a-z][a-z0-9+.-]*:|//)"
PAGE = r"(?i)\.(md|mdx|mdc|markdown)$"
MACHINE = r"^/(Users|home|tmp|var|opt|mnt)/"
ENDINGS = ("", ".md", ".mdx", ".markdown", ".rst", ".adoc", "/index.md", "/index.mdx", "/README.md", "/_index.md")
STATIC = ("public", "static")
COMMUNITY = (
    ("README.md", r"^readme(\.[a-z-]+)?\.(md|mdx|rst|txt)$", True),
    ("LICENSE", r"^(licen[sc]e|copying)(\.[a-z-]+)?(\.(md|txt|rst))?$", True),
    ("CONTRIBUTING.md", r"^contributing(\.[a-z-]+)?\.(md|mdx|rst|txt)$", True),
    ("CODE_OF_CONDUCT.md", r"^code[-_]?of[-_]?conduct(\.[a-z-]+)?\.(md|mdx|rst|txt)$", False),
    ("SECURITY.md", r"^security(\.[a-z-]+)?\.(md|mdx|rst|txt)$", False),
    ("CHANGELOG.md", r"^(changelog|changes|history|news)(\.[a-z-]+)?\.(md|mdx|rst|txt)$", False),
)
NAVS = (
    ("mkdocs", r"(?i)^mkdocs\.ya?ml$"),
    ("mdbook", r"(?i)((^|/)src/SUMMARY\.md$|^SUMMARY\.md$)"),
    ("docsify", r"(?i)(^|/)_sidebar\.md$"),
    ("sphinx", r"(?i)^(docs?|source)/index\.(md|rst)$"),
    ("antora", r"(?i)(^|/)modules/[^/]+/nav\.adoc$"),
)
NOT_ORPHANS = r"(?i)(^|/)(SUMMARY|_sidebar|_navbar|_coverpage|index|README)\.md$"
PAGE_END = compiled(r"\.(md|mdx|mdc|markdown|rst|adoc)$", "i")
NAV_BLOCK = compiled(r"^nav:[ \t]*\n((?:[ \t]+[^\n]*\n?|\n)*)", "m")
NAV_PAGE = compiled(r"""(?::|^\s*-)\s+['"]?([^\s'"#:]+\.(?:md|mdx))['"]?\s*$""", "i")
NAV_XREF = compiled(r"xref:([^[\]\s]+?)(?:\.adoc)?\[")
TREE_FENCE = compiled(r"^(```+|~~~+)\{toctree\}[^\n]*\n([\s\S]*?)^\1", "gm")
TREE_DIRECTIVE = compiled(r"^\.\.[ \t]+toctree::[^\n]*\n((?:[ \t]+[^\n]*\n|\n)*)", "gm")
TREE_TARGET = r"<([^<>]+)>\s*$"
COLUMNS = ["rule_id", "family", "severity", "file", "line", "col", "span", "message"]


def blanked(m: re.Match, group: int = 0) -> str:
    return m[0][: m.start(group) - m.start()] + re.sub("[^\n]", " ", m[group])


def without_code(text: str) -> str:
    text = FENCED.sub(blanked, text)
    return CODE.sub(blanked, INDENTED.sub(lambda m: blanked(m, 2), text))


def links(text: str) -> tuple[list[tuple], list[tuple]]:
    """(href, offset, span) of all links, and (id, offset, span) of references without a definition."""
    shown, out, lost, defined = without_code(text), [], [], {}
    for m in DEFINITION.finditer(shown):
        defined[m[1].lower()] = m[2].strip("<>")
        out.append((defined[m[1].lower()], m.start(), m[0].strip()))
    out += [(m[2].strip("<>"), m.start(), m[0]) for m in INLINE.finditer(shown)]
    for m in REFERENCE.finditer(shown):
        name = m[2] or m[1]
        if name.lower() in defined:
            out.append((defined[name.lower()], m.start(), m[0]))
        else:
            lost.append((name, m.start(), m[0]))
    return out, lost


def slug(title: str) -> str:
    return re.sub(r"\s", "-", re.sub(PUNCTUATION, "", re.sub("<[^>]*>", "", title.lower().strip())))


def anchors(text: str) -> list[str]:
    """Slugs of headings, numbered where they repeat, and names given in the text."""
    shown, out, count = without_code(text), {}, {}
    for m in ATX.finditer(shown):
        title = ATX.match(text[m.start() : m.end()])
        title = title[1] if title else ""
        if not title:
            continue
        if own := CUSTOM.search(title):
            out[own[1]] = None
            title = title[: own.start()]
        base = slug(re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", title))
        n = count[base] = count.get(base, -1) + 1
        out[base if not n else f"{base}-{n}"] = None
    out.update((m[1], None) for m in NAMED.finditer(text))
    return list(out)


PARSED = "struct<links:array<struct<href:string,line:int,col:int,span:string>>,lost:array<struct<href:string,line:int,col:int,span:string>>,anchors:array<string>>"
LINK = pa.struct([("href", pa.string()), ("line", pa.int32()), ("col", pa.int32()), ("span", pa.string())])


def _read(texts: pa.Array) -> pa.Array:
    columns: tuple[list, list, list] = ([], [], [])
    for t in texts.to_pylist():
        t = t or ""
        place = lambda o, t=t: (t.count("\n", 0, o) + 1, o - t.rfind("\n", 0, o))
        for column, found in zip(columns, links(t), strict=False):
            column.append([{"href": h, "line": place(o)[0], "col": place(o)[1], "span": s[:120]} for h, o, s in found])
        columns[2].append(anchors(t))
    kinds = (pa.list_(LINK), pa.list_(LINK), pa.list_(pa.string()))
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["links", "lost", "anchors"])


def read_pages(pages: DataFrame) -> DataFrame:
    """path, links, lost and anchors of the markdown pages among pages (path, text)."""
    ship(pages.sparkSession)
    read = F.arrow_udf(_read, PARSED)
    return pages.filter(F.col("path").rlike(PAGE)).select("path", read("text").alias("x")).select("path", "x.*")


def targets(paths: DataFrame) -> DataFrame:
    """target, path: every file and, once, every folder that holds one."""
    folders = paths.select(F.split("path", "/").alias("p")).select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("p") - 1, F.lit(1))), lambda k: F.when(F.size("p") > 1, F.array_join(F.slice("p", 1, k), "/")))).alias("target"))
    files = paths.select(F.col("path").alias("target"), F.lit(True).alias("file"))
    return files.union(folders.filter("target IS NOT NULL").select("target", F.lit(False))).groupBy("target").agg(F.max("file").alias("file"))


def candidates(at):
    """Paths that a link to at may mean, in order of preference."""
    clean = F.regexp_replace(at, "/+$", "")
    page = clean.rlike(r"(?i)\.html?$")
    html = [F.when(page, F.regexp_replace(clean, r"(?i)\.html?$", e)) for e in (".md", ".mdx")]
    return F.array(at, *[F.concat(clean, F.lit(e)) for e in ENDINGS], *html)


def found(links_: DataFrame, tree: DataFrame) -> DataFrame:
    """id, target: for each link with options (an array of paths), the first that exists; folders count for the bare path only."""
    rows = links_.select("id", F.posexplode("options").alias("pos", "target")).filter("target IS NOT NULL AND target <> ''")
    hits = rows.join(tree, "target").filter(F.col("file") | (F.col("pos") % (len(ENDINGS) + 3) <= 1))
    rank = F.col("pos") + F.when(F.col("file"), 0).otherwise(F.lit(len(ENDINGS) + 2) - F.col("pos") % (len(ENDINGS) + 3))
    return hits.groupBy("id").agg(F.min_by("target", rank).alias("target"))


def finding(rule, severity, file, line, col, span, message):
    return [F.lit(rule).alias("rule_id") if isinstance(rule, str) else rule.alias("rule_id"), F.lit("structure").alias("family"), F.lit(severity).alias("severity") if isinstance(severity, str) else severity.alias("severity"), file.alias("file"), line.alias("line"), col.alias("col"), span.alias("span"), message.alias("message")]


def check_links(pages: DataFrame, paths: DataFrame) -> DataFrame:
    """Findings: links to nothing, to missing anchors, to one person's machine, and references without a definition."""
    read = settled(read_pages(pages))
    tree = settled(targets(paths))
    lost = read.select("path", F.inline("lost")).select(*finding("link-undefined-reference", "warn", F.col("path"), F.col("line"), F.col("col"), F.col("span"), F.concat(F.lit('No definition for "'), "href", F.lit('"'))))
    rows = read.select("path", F.inline("links")).withColumn("href", F.trim("href")).filter((F.col("href") != "") & ~F.col("href").rlike(EXTERNAL))
    rows = rows.withColumn("id", F.xxhash64("path", "line", "col", "href", "span"))
    rows = rows.withColumns({"part": F.regexp_extract("href", "^([^#]*)", 1), "fragment": F.regexp_extract("href", "^[^#]*#([^#]*)", 1)})
    plain = F.coalesce(F.expr("try_url_decode(replace(part, '+', '%2B'))"), "part")
    rows = rows.withColumns({"plain": plain, "name": F.coalesce(F.expr("try_url_decode(replace(fragment, '+', '%2B'))"), "fragment"), "root": F.col("part").startswith("/")})
    here = F.filter(F.split(F.regexp_extract("path", "^(.*)/", 1), "/"), lambda x: x != "")
    bases = F.concat(F.transform(F.sequence(F.lit(0), F.size(here)), lambda k: F.when(k > 0, F.array_join(F.slice(here, 1, F.greatest(k, F.lit(1))), "/")).otherwise("")), F.array(*map(F.lit, STATIC)))
    absolute = F.flatten(F.transform(bases, lambda b: candidates(F.concat(F.when(b == "", "").otherwise(F.concat(b, F.lit("/"))), F.expr("substring(plain, 2)")))))
    rows = rows.withColumn("to", F.when(~F.col("root"), resolved(F.col("path"), F.col("plain"))))
    rows = rows.withColumn("options", F.when(F.col("part") == "", F.array("path")).when(F.col("root"), absolute).otherwise(candidates(F.col("to"))))
    hit = settled(rows.join(found(rows, tree), "id", "left"))
    gone = hit.filter("target IS NULL AND part <> ''")
    rule = F.when(~F.col("root"), "link-broken").when(F.col("part").rlike(MACHINE), "link-machine-path").otherwise("link-unresolved-absolute")
    broken = gone.select(*finding(rule, F.when(rule == "link-unresolved-absolute", "advisory").otherwise("warn"), F.col("path"), F.col("line"), F.col("col"), F.col("span"), F.concat(F.lit('Nothing at "'), "href", F.lit('"'))))
    names = read.select(F.col("path").alias("target"), F.explode("anchors").alias("name")).distinct()
    pointed = hit.filter("fragment <> ''").withColumn("target", F.when(F.col("part") == "", F.col("path")).otherwise(F.col("target")))
    pointed = pointed.join(pages.select(F.col("path").alias("target")).distinct(), "target", "left_semi").join(names, ["target", "name"], "left_anti")
    stray = pointed.select(*finding("link-broken-anchor", "advisory", F.col("path"), F.col("line"), F.col("col"), F.col("span"), F.concat(F.lit('No heading for "#'), "fragment", F.lit('"'))))
    return lost.union(broken).union(stray)


def check_community(paths: DataFrame) -> DataFrame:
    """Findings: files that a project should have at its root, in .github or docs."""
    base = F.element_at(F.split("path", "/"), -1)
    near = paths.filter(F.col("path").rlike(r"(?i)^(\.github/|docs/)?[^/]+\z"))
    flags = near.agg(*[F.coalesce(F.max(base.rlike("(?i)" + p[:-1] + r"\z")), F.lit(False)).alias(f"c{k}") for k, (_, p, _) in enumerate(COMMUNITY)])
    rows = F.array(*[F.when(~F.col(f"c{k}"), F.struct(F.lit(name).alias("span"), F.lit("warn" if must else "advisory").alias("severity"))) for k, (name, _, must) in enumerate(COMMUNITY)])
    out = flags.select(F.inline(F.filter(rows, lambda x: x.isNotNull())))
    return out.select(*finding("community-missing-file", F.col("severity"), F.lit("(project)"), F.lit(1), F.lit(1), F.col("span"), F.concat(F.lit("No "), "span")))


def join_path(base: str, href: str) -> str | None:
    out: list[str] = [] if href.startswith("/") else base.split("/")[:-1]
    for part in href.split("/"):
        if part == "..":
            if not out:
                return None
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(x for x in out if x)


def nav_entries(kind: str, path: str, text: str) -> tuple[str, list[str], bool] | None:
    """Folder of the pages, entries of a navigation file, and whether it takes pages by pattern; None if it names none."""
    folder = "/".join(path.split("/")[:-1])
    inside = [h.split("#")[0].split("?")[0] if kind == "docsify" else h.split("#")[0] for h, *_ in links(text)[0]] if kind in ("mdbook", "docsify") else []
    inside = [h for h in inside if h and not re.match(EXTERNAL, h)]
    if kind == "mkdocs":
        block = NAV_BLOCK.search(text)
        if not block:
            return None
        found = (NAV_PAGE.search(x) for x in block[1].split("\n"))
        return "docs", ["docs/" + re.sub(r"^\./", "", m[1]) for m in found if m], False
    if kind == "mdbook":
        return folder, [p for h in inside if (p := join_path(path, h))], False
    if kind == "docsify":
        names = [re.sub("^/", "", h) or "README.md" for h in inside]
        return folder, [p for n in names if (p := join_path(path, n if PAGE_END.search(n) else n + ".md"))], False
    if kind == "antora":
        root = re.sub(r"(?i)/nav\.adoc$", "", path)
        return root + "/pages", [f"{root}/pages/{m[1]}.adoc" for m in NAV_XREF.finditer(text)], False
    trees = [m[2] for m in TREE_FENCE.finditer(text)] + [m[1] for m in TREE_DIRECTIVE.finditer(text)]
    if not trees:
        return None
    out, pattern = [], False
    for line in (x.strip() for t in trees for x in t.split("\n")):
        if not line or line.startswith(":") or re.search("[*?]", line):
            pattern |= line.startswith(":glob:") or bool(line) and not line.startswith(":")
            continue
        name = re.search(TREE_TARGET, line)
        name = name[1] if name else line
        if p := join_path(path, name if PAGE_END.search(name) else name + ".md"):
            out.append(p)
    return folder, out, pattern


def check_nav(pages: DataFrame, paths: DataFrame) -> DataFrame:
    """Findings: navigation entries without a file, and pages outside the navigation.  A tree has at most one navigation file of each of the five kinds, the first by path."""
    spark = paths.sparkSession
    ship(spark)
    kind = F.coalesce(*[F.when(F.col("path").rlike(p), F.lit(k)) for k, p in NAVS])
    first = paths.select(kind.alias("kind"), "path").filter("kind IS NOT NULL").groupBy("kind").agg(F.min("path").alias("nav"))
    rows = pages.join(first, pages["path"] == first["nav"]).select("kind", "nav", "text")

    @F.arrow_udf("struct<folder:string,entries:array<string>,pattern:boolean>")
    def read(kinds: pa.Array, navs: pa.Array, texts: pa.Array) -> pa.Array:
        got = [nav_entries(k, p, t or "") for k, p, t in zip(kinds.to_pylist(), navs.to_pylist(), texts.to_pylist(), strict=True)]
        return pa.array([{"folder": g[0], "entries": g[1], "pattern": g[2]} if g else None for g in got], pa.struct([("folder", pa.string()), ("entries", pa.list_(pa.string())), ("pattern", pa.bool_())]))

    navs = rows.select("kind", "nav", read("kind", "nav", "text").alias("x")).filter("x IS NOT NULL").select("kind", "nav", "x.*")
    entries = navs.select("kind", "nav", F.posexplode("entries").alias("pos_", "entry")).withColumn("id", F.xxhash64("kind", "nav", "pos_", "entry"))
    entries = entries.withColumn("options", candidates(F.col("entry")))
    hit = settled(entries.join(found(entries, targets(paths).filter("file")), "id", "left"))
    none = hit.filter("target IS NULL").select(*finding("nav-missing-target", "warn", F.col("nav"), F.lit(1), F.lit(1), F.col("entry"), F.concat(F.lit('No file for the entry "'), "entry", F.lit('"'))))
    held = paths.filter(F.col("path").rlike(r"(?i)\.(md|mdx)$") & ~F.col("path").rlike(NOT_ORPHANS))
    open_ = navs.filter("NOT pattern").select("kind", "nav", "folder")
    outside = held.join(F.broadcast(open_), F.col("path").startswith(F.concat("folder", F.lit("/"))) & (F.col("path") != F.col("nav")))
    outside = outside.join(hit.select("kind", F.col("target").alias("path")), ["kind", "path"], "left_anti")
    orphans = outside.select(*finding("nav-orphan-page", "advisory", F.col("path"), F.lit(1), F.lit(1), F.col("path"), F.concat(F.lit("Not reachable from "), "nav")))
    return none.union(orphans)


def check_site(pages: DataFrame, paths: DataFrame) -> DataFrame:
    return check_links(pages, paths).union(check_nav(pages, paths)).union(check_community(paths)).orderBy("file", "line", "col", "rule_id")
