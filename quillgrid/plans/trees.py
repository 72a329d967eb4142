"""Queries over trees of files made of the nations, and over slots filled with functions that SQL can follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.operators import assoc, code, detect, i18n, lineage, models, segments, site, structure
from quillgrid.plans.queries import edges, long, query, read, scratch
from quillgrid.sources import files

def number():
    return F.col("n_nationkey")


def said(*parts):
    """Parts of a text, in a row: names of columns in braces stand for them."""
    return F.concat(*[F.col(p[1:-1]).cast("string") if p.startswith("{") else F.lit(p) for p in parts])


def named(spark, sf_dir, *choices):
    """path of each nation: the choice of its key, with ? for the key."""
    paths = F.array(*[F.regexp_replace(F.lit(c), r"\?", number().cast("string")) for c in choices])
    return read(spark, sf_dir, "nation").withColumn("path", F.element_at(paths, (number() % len(choices) + 1).cast("int")))


# --- reading ------------------------------------------------------------------------------------------------


@query("SELECT 'a/n' || n_nationkey || '.md' AS path, 'repeated-word' AS rule_id, 3::BIGINT AS line FROM nation WHERE n_nationkey % 6 = 0 UNION ALL SELECT 'b/c/n' || n_nationkey || '.mdx', 'repeated-word', 3 FROM nation WHERE n_nationkey % 6 = 1")
def tree_findings(spark, sf_dir):
    """A tree of files, written and read again: translations, generated files, other people's code and sources are passed over."""
    choices = ("a/n?.md", "b/c/n?.mdx", "a/n?.es.md", "node_modules/x?/n.md", "c?/CHANGELOG.md", "src/n?.py")
    rows = named(spark, sf_dir, *choices).select("path", said("# ", "{n_name}", "\n\nIt was was late.\n").alias("text"))
    folder = scratch(spark)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for r in rows.collect():  # a file each, of a table of 25 rows
        at = fs_path(f"{folder}/{r.path}")
        out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
        out.write(bytearray(r.text.encode()))
        out.close()
    found = files.detected(spark, folder, detect.Settings(only=frozenset(["repeated-word"])))
    return found.select("path", "rule_id", long("line"))


@query("SELECT 'n' || n_nationkey || '.md' AS path FROM nation WHERE n_nationkey % 6 = 0 UNION ALL SELECT 'src/n' || n_nationkey || '.py' FROM nation WHERE n_nationkey % 6 = 1")
def textual_files(spark, sf_dir):
    rows = named(spark, sf_dir, "n?.md", "src/n?.py", "n?.test.js", "build/n?.py", "n?.png", ".x/n?.md")
    return files.textual(rows.select("path", F.lit("x").alias("text"))).select("path")


@query("SELECT 'n' || n_nationkey || '.md' AS path FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'a/n' || n_nationkey || '.md' FROM nation WHERE n_nationkey % 3 = 1")
def shallow_paths(spark, sf_dir):
    return files.shallow(named(spark, sf_dir, "n?.md", "a/n?.md", "a/b/n?.md"), 2).select("path")


@query("SELECT n_nationkey::BIGINT AS n, lower(n_name) AS claim FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey::BIGINT, 'x' FROM nation WHERE n_nationkey % 2 = 0")
def claims_file(spark, sf_dir):
    """A file of claims by sentence: cut to words, each once whatever its case, and none that is empty."""
    one = F.to_json(F.struct(number().alias("i"), F.array(said(" ", "{n_name}", " "), F.upper("n_name"), F.lit(""), F.lit("x")).alias("claims")))
    rows = read(spark, sf_dir, "nation").filter(number() % 2 == 0).withColumn("n_name", F.lower("n_name")).select(F.concat(F.lit("["), one, F.lit("]")).alias("value"))
    return files.claims(rows).select(long("n"), F.explode("claims").alias("claim"))


# --- sites, platforms, translations -------------------------------------------------------------------------


@query(
    "SELECT 'docs/n' || n_nationkey || '.md' AS file, rule_id, severity FROM nation JOIN (VALUES (0, 'link-broken', 'warn'), (1, 'link-broken-anchor', 'advisory'), (2, 'link-undefined-reference', 'warn'), (3, 'link-machine-path', 'warn'), (4, 'link-unresolved-absolute', 'advisory')) v(k, rule_id, severity) ON n_nationkey % 7 = k"
)
def link_kinds(spark, sf_dir):
    """A link of each kind by the key: to nothing, to no heading, without a definition, to one person's machine, to nothing from the root; and two good ones, one to the second of two like headings."""
    links = F.array(*map(F.lit, ("[x](gone.md)", "[x](#nowhere)", "[x][gone]", "[x](/Users/me/x.md)", "[x](/gone.md)", "[x](#part-one-1)", "[x][here]\n\n[here]: ../README.md#top-of-it")))
    text = F.concat(F.lit("# Part one\n\n## Part one\n\n"), F.element_at(links, (number() % 7 + 1).cast("int")), F.lit("\n"))
    pages = read(spark, sf_dir, "nation").select(said("docs/n", "{n_nationkey}", ".md").alias("path"), text.alias("text"))
    pages = pages.union(spark.createDataFrame([("README.md", "# Top of it\n")], "path string, text string"))
    return site.check_links(pages, pages.select("path")).select("file", "rule_id", "severity")


@query(
    "SELECT rule_id, file, span FROM (VALUES ('mkdocs.yml', 'docs/none.md'), ('book/src/SUMMARY.md', 'book/src/none.md'), ('side/_sidebar.md', 'side/none.md'), ('source/index.md', 'source/none.md'), ('modules/ROOT/nav.adoc', 'modules/ROOT/pages/none.adoc')) v(file, span), (SELECT 'nav-missing-target' AS rule_id) UNION ALL SELECT 'nav-orphan-page', f || 'n' || n_nationkey || '.md', f || 'n' || n_nationkey || '.md' FROM nation, (VALUES ('docs/'), ('book/src/'), ('side/'), ('source/')) w(f)"
)
def navigation_kinds(spark, sf_dir):
    """A navigation file of each of five kinds: of two entries one has a file, and the nations' pages beside it are in none."""
    navs = [
        ("mkdocs.yml", "nav:\n  - A: a.md\n  - None: none.md\n"), ("book/src/SUMMARY.md", "- [a](a.md)\n- [n](none.md)\n"), ("side/_sidebar.md", "- [a](a)\n- [n](none.md)\n"),
        ("source/index.md", "```{toctree}\n:maxdepth: 1\na\nNone <none>\n```\n"), ("modules/ROOT/nav.adoc", "* xref:a.adoc[]\n* xref:none.adoc[]\n"),
    ]
    there = [("docs/a.md",), ("book/src/a.md",), ("side/a.md",), ("source/a.md",), ("modules/ROOT/pages/a.adoc",), *[(p,) for p, _ in navs]]
    folders = F.explode(F.array(*map(F.lit, ("docs/", "book/src/", "side/", "source/")))).alias("f")
    own = read(spark, sf_dir, "nation").select(folders, "n_nationkey").select(said("{f}", "n", "{n_nationkey}", ".md").alias("path"))
    return site.check_nav(spark.createDataFrame(navs, "path string, text string"), own.union(spark.createDataFrame(there, "path string"))).select("rule_id", "file", "span")


@query("SELECT id FROM (VALUES ('mkdocs'), ('docusaurus'), ('sphinx'), ('hugo'), ('jekyll'), ('mdbook'), ('antora'), ('docsify'), ('vitepress'), ('starlight'), ('gitbook'), ('readthedocs')) v(id)")
def platform_kinds(spark, sf_dir):
    """A tree with a file for every generator, among the nations' pages."""
    signs = ["mkdocs.yml", "website/docusaurus.config.ts", "docs/conf.py", "config/_default/hugo.toml", "_config.yml", "book.toml", "antora.yml", "docs/_sidebar.md", "docs/.vitepress/config.mts", "astro.config.mjs", "src/content/docs/a.md", "book.json", ".readthedocs.yaml"]
    own = read(spark, sf_dir, "nation").select(said("docs/n", "{n_nationkey}", ".md").alias("path"))
    return structure.platforms(own.union(spark.createDataFrame([(x,) for x in signs], "path string"))).select("id")


@query(
    "SELECT path, layout, locale, is_source FROM (SELECT n_nationkey AS k, v.*, replace(v.p, '?', n_nationkey::VARCHAR) AS path FROM nation JOIN (VALUES (0, 'web?/docs/x.md', 'docusaurus', 'en', true), (0, 'web?/i18n/fr/docusaurus-plugin-content-docs/current/x.md', 'docusaurus', 'fr', false), (1, 'h?/content/a.md', 'hugo', 'en', true), (1, 'h?/content.de/a.md', 'hugo', 'de', false), (2, 'd?/en/p.md', 'dir', 'en', true), (2, 'd?/pt-br/p.md', 'dir', 'pt-br', false), (3, 's?/r.md', 'suffix', 'en', true), (3, 's?/r.zh-cn.md', 'suffix', 'zh-cn', false), (4, 'my/page?.md', 'mirror', 'en', true), (4, 'theirs/nl/page?.md', 'mirror', 'nl', false)) v(m, p, layout, locale, is_source) ON n_nationkey % 5 = v.m)"
)
def translation_layouts(spark, sf_dir):
    """Two versions of a page in each of four layouts and one of one's own, by the key."""
    pairs = [("web?/docs/x.md", "web?/i18n/fr/docusaurus-plugin-content-docs/current/x.md"), ("h?/content/a.md", "h?/content.de/a.md"), ("d?/en/p.md", "d?/pt-br/p.md"), ("s?/r.md", "s?/r.zh-cn.md"), ("my/page?.md", "theirs/nl/page?.md")]
    paths = named(spark, sf_dir, *[a for a, _ in pairs]).select("path").union(named(spark, sf_dir, *[b for _, b in pairs]).select("path"))
    return i18n.sets(paths, mirrors=(("my", "theirs/{locale}"),)).select("path", "layout", "locale", "is_source")


# --- sources of programs ------------------------------------------------------------------------------------


@query(
    "SELECT replace(v.p, '?', n_nationkey::VARCHAR) AS path, v.name, v.kind, v.line::BIGINT AS line FROM nation JOIN (VALUES (0, 'n?.ts', 'one', 'function', 1), (0, 'n?.ts', 'two', 'const', 2), (0, 'n?.ts', 'four', 'export', 3), (0, 'n?.ts', 'Five', 'type', 4), (1, 'n?.go', 'Run', 'function', 2), (1, 'n?.go', 'Thing', 'type', 4), (2, 'n?.rs', 'open_it', 'item', 1), (2, 'n?.rs', 'Held', 'item', 3), (3, 'n?.py', 'go_on', 'function', 1), (3, 'n?.py', 'Box', 'class', 4)) v(m, p, name, kind, line) ON n_nationkey % 4 = v.m"
)
def surface_languages(spark, sf_dir):
    texts = ("export async function one(a) {}\nexport const two = 1\nexport { three as four, _no }\nexport interface Five {}\n", "package x\nfunc Run(a int) {\n}\ntype Thing struct {\nfunc hidden() {\n", "pub fn open_it() {}\nfn closed() {}\npub struct Held;\n", "async def go_on(a):\n    pass\n\nclass Box(x):\n    pass\ndef _no():\n")
    rows = named(spark, sf_dir, "n?.ts", "n?.go", "n?.rs", "n?.py").select("path", F.element_at(F.array(*map(F.lit, texts)), (number() % 4 + 1).cast("int")).alias("text"))
    return code.surface(rows).select("path", "name", "kind", long("line"))


@query("SELECT 'src/n' || n_nationkey || '.ts' AS path, v.line::BIGINT AS line FROM nation, (VALUES (2), (5)) v(line)")
def script_strings(spark, sf_dir):
    """Strings and comments of scripts: not the license, not code, not patterns."""
    text = "// Copyright the the owner\nconst a = 'so so it goes'\nlet the, the2 = /the the/\nlet b = the\n/* again again */\n"
    rows = read(spark, sf_dir, "nation").select(said("src/n", "{n_nationkey}", ".ts").alias("path"), F.lit(text).alias("text"))
    return detect.detected(code.readable(rows), detect.Settings(only=frozenset(["repeated-word"])), "path").select("path", long("line"))


@query(
    "SELECT replace(v.p, '?', n_nationkey::VARCHAR) AS path, v.text FROM nation JOIN (VALUES (0, 'n?.py', 'a = ''#x'' ' || repeat(' ', 6) || chr(10) || 'b'), (1, 'n?.js', 'a(); ' || repeat(' ', 4) || chr(10) || repeat(' ', 4) || ' d ' || repeat(' ', 4)), (2, 'n?.sql', 'select 1 ' || repeat(' ', 4)), (3, 'n?.lua', 'x ' || repeat(' ', 9) || ' y'), (4, 'n?.txt', 'a # b')) v(m, p, text) ON n_nationkey % 5 = v.m"
)
def blanked_comments(spark, sf_dir):
    """Comments of four families of languages; other texts stay."""
    texts = ("a = '#x' # note\nb", "a(); /* b\nc */ d // e", "select 1 -- x", "x --[[ a ]] y", "a # b")
    rows = named(spark, sf_dir, "n?.py", "n?.js", "n?.sql", "n?.lua", "n?.txt").select("path", F.element_at(F.array(*map(F.lit, texts)), (number() % 5 + 1).cast("int")).alias("text"))
    return code.uncommented(rows)


@query("SELECT n_nationkey::BIGINT AS doc_id, 'a' AS alt, 'i.png' AS target, 3::BIGINT AS break_line, 5::BIGINT AS first_row, 2::BIGINT AS table_rows, 'k' AS defined, (length(n_name) + 49)::BIGINT AS at, 'k' AS used, 2::BIGINT AS bold FROM nation")
def markdown_marks(spark, sf_dir):
    """Images, thematic breaks, tables, definitions (from the empty line before, which white space at their start takes in) and their uses, and bold spans."""
    text = said("![a](i.png)\n\n---\n\n| ", "{n_name}", " | y |\n|---|---|\n\nSome text.\n\n[k]: http://x.org\n\nSee [k] and [t][K]. **b** or __c__\n")
    out = segments.segmented(read(spark, sf_dir, "nation").select(number().cast("long").alias("doc_id"), text.alias("text")))
    return out.select(
        "doc_id", F.col("images")[0]["text"].alias("alt"), F.col("images")[0]["target"].alias("target"), F.col("breaks")[0]["line"].cast("long").alias("break_line"), F.col("tables")[0].cast("long").alias("first_row"), F.size("tables").cast("long").alias("table_rows"),
        F.col("definitions")[0]["id"].alias("defined"), F.col("definitions")[0]["start"].cast("long").alias("at"), F.array_join("uses", ",").alias("used"), F.size("bold").cast("long").alias("bold"),
    )


@query("SELECT (25 + row_number() OVER (ORDER BY 'n/' || n_nationkey || '.py'))::BIGINT AS id, 'n/' || n_nationkey || '.py' AS src_file, 'r/' || n_regionkey || '.md' AS dst_file, 'confirmed' AS status, 'manual' AS via, 'me' AS curated_by, '# head' AS src_text FROM nation")
def edge_links(spark, sf_dir):
    """Links that a curator states, numbered on from the 25 edges there are."""
    e, tree = edges(spark, sf_dir)
    one, none = F.lit(1), F.lit(None).cast("string")
    links = read(spark, sf_dir, "nation").select(said("n/", "{n_nationkey}", ".py").alias("src_file"), one.alias("src_start"), one.alias("src_end"), said("r/", "{n_regionkey}", ".md").alias("dst_file"), one.alias("dst_start"), one.alias("dst_end"), none.alias("rel"), none.alias("note"), F.lit("me").alias("by"))
    out = lineage.linked(e, links, tree).filter("via = 'manual'")
    return out.select(long("id"), "src_file", "dst_file", "status", "via", "curated_by", "src_text")


@query("SELECT n_nationkey::BIGINT + 1 AS id, 2::BIGINT AS src_start, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 3 END::BIGINT AS src_end, CASE WHEN n_nationkey % 2 = 0 THEN 'def ' || lower(n_name) || '():' ELSE 'def ' || lower(n_name) || '():' || chr(10) || '    return ' || n_nationkey END AS src_text FROM nation")
def edge_spans(spark, sf_dir):
    """Spans of edges of an even key made narrower."""
    e, tree = edges(spark, sf_dir)
    narrower = read(spark, sf_dir, "nation").filter(number() % 2 == 0).select((number() + 1).cast("int").alias("id"), F.lit(2).alias("src_start"), F.lit(2).alias("src_end"), F.lit(None).cast("int").alias("dst_start"), F.lit(None).cast("int").alias("dst_end"))
    return lineage.respanned(e, narrower, tree).select(long("id"), long("src_start"), long("src_end"), "src_text")


@query("SELECT 'n/' || a.n_nationkey AS src_file, 'n/' || b.n_nationkey AS dst_file, 'related' AS rel, 'embedding' AS via FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1 WHERE a.n_nationkey % 2 = 0")
def association_proposals(spark, sf_dir):
    """Proposals of associations of some score: those of odd keys have less."""
    end = lambda k: F.struct(F.concat(F.lit("n/"), k).alias("path"), F.lit("L1").alias("chunk"), F.lit(1).alias("start"), F.lit(2).alias("end"))
    rows = read(spark, sf_dir, "nation").filter("n_nationkey < 24").select(end(number()).alias("a"), end(number() + 1).alias("b"), F.when(number() % 2 == 0, 0.6).otherwise(0.4).alias("score"), F.lit("embedding").alias("via"))
    return lineage.from_associations(rows, 0.5).select("src_file", "dst_file", "rel", "via")


# --- what is set up -----------------------------------------------------------------------------------------


@query("SELECT type, n_nationkey::BIGINT AS k, 0::BIGINT AS missing FROM nation, (VALUES ('adr'), ('postmortem'), ('runbook'), ('rfc'), ('contributing'), ('code-of-conduct'), ('governance'), ('security')) v(type)")
def templates(spark, sf_dir):
    """A document of every archetype for each nation, held to its own sections."""
    kinds = spark.createDataFrame([(t, structure.template(t, "A title")) for t in structure.BY_TYPE], "type string, text string")
    n = read(spark, sf_dir, "nation").select(number().cast("long").alias("k"))
    rows = n.join(F.broadcast(kinds), F.lit(True)).withColumn("path", said("{type}", "/", "{k}", ".md"))
    out = structure.assets(rows, "type")
    return out.select("type", F.regexp_extract("path", "/([0-9]+)[.]md", 1).cast("long").alias("k"), F.size("findings").cast("long").alias("missing"))


@query("SELECT id, id AS found FROM (VALUES ('mkdocs'), ('docusaurus'), ('sphinx'), ('hugo'), ('jekyll'), ('mdbook'), ('antora'), ('docsify')) v(id)")
def starters(spark, sf_dir):
    """The first files of every generator, and what they are taken for."""
    out = None
    for name in structure.STARTERS:
        paths = spark.createDataFrame([(p,) for p, _ in structure.starter(name)], "path string")
        part = structure.platforms(paths).select(F.lit(name).alias("id"), F.col("id").alias("found"))
        out = part if out is None else out.union(part)
    return out


# --- slots --------------------------------------------------------------------------------------------------


def digits(text: str) -> set[str]:
    return {w.strip(".!$") for w in text.split() if any(c.isdigit() for c in w)}


@query(
    "SELECT n_nationkey::BIGINT AS doc_id, CASE n_nationkey % 3 WHEN 1 THEN 'contradicts-fact' ELSE 'unsupported-claim' END AS rule_id, CASE n_nationkey % 3 WHEN 1 THEN 'error' ELSE 'advisory' END AS severity FROM nation WHERE n_nationkey % 3 > 0"
)
def entailment_slot(spark, sf_dir):
    """Claims on towns with a number that is the fact's, another, or none; the judge compares numbers."""

    def judge(facts: list[str], claims: list[str]) -> list[tuple[float, float]]:
        return [(0.1, 0.2) if not digits(c) & {"7", "8"} else (0.05, 0.9) if digits(c) & {"7", "8"} <= digits(f) else (0.9, 0.05) for f, c in zip(facts, claims, strict=True)]

    n = read(spark, sf_dir, "nation").withColumn("m", F.element_at(F.array(F.lit("7"), F.lit("8"), F.lit("many")), (number() % 3 + 1).cast("int")))
    docs = n.select(F.col("n_nationkey").cast("long").alias("doc_id"), said("The old town Zed", "{n_nationkey}", " has ", "{m}", " bridges there.").alias("text"))
    facts = n.select(F.col("n_nationkey").cast("long").alias("fact"), said("The town Zed", "{n_nationkey}", " has 7 bridges.").alias("text"), F.lit(None).cast("string").alias("source"))
    return models.entailed(docs, facts, judge).select("doc_id", "rule_id", "severity")


@query("SELECT n_nationkey::BIGINT AS doc_id, 2::BIGINT AS line, (length(n_name) + 14)::BIGINT AS start FROM nation")
def lookback_slot(spark, sf_dir):
    """Sentences that a context gives little to, if they are of 12 characters."""
    docs = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), said("{n_name}", " is old. Yes.\nThis is said without ground.").alias("text"))
    found = models.ungrounded(docs, lambda rows: [0.5 if "old" in x else 0.05 for x in rows])
    return found.select("doc_id", long("line"), F.col("offset").cast("long").alias("start"))


@query("SELECT n_nationkey::BIGINT AS doc_id, v.text FROM nation JOIN (VALUES ('two words', 0, 0.5), ('more of it', 40, 0.2)) v(text, start, score) ON n_nationkey % 2 = 0 OR v.start = 40")
def slop_span_slot(spark, sf_dir):
    """Spans of several words and some score that overlap no finding on machine prose: documents of odd keys have one at the first."""
    spans = [("two words", 0, 9, 0.5), ("word", 20, 24, 0.9), ("more of it", 40, 50, 0.2), ("too low by far", 60, 70, 0.1)]
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"))
    rows = n.join(F.broadcast(spark.createDataFrame(spans, "text string, start int, end int, score double")), F.lit(True))
    found = n.filter("doc_id % 2 = 1").select("doc_id", F.lit(4).alias("offset"), F.lit(3).alias("length"), F.lit("ai-slop").alias("family"))
    return models.slop_spans(rows, found.union(n.select("doc_id", F.lit(40), F.lit(3), F.lit("style")))).select("doc_id", "text")


@query("SELECT n_nationkey::BIGINT AS doc_id, v.n::BIGINT AS n, CASE v.n WHEN 0 THEN n_name || ' is here.' WHEN 1 THEN repeat('x', 1000) ELSE repeat('x', 200) END AS text FROM nation, (VALUES (0), (1), (2)) v(n)")
def model_paragraphs(spark, sf_dir):
    text = F.concat(F.lit("# Head\n\n"), "n_name", F.lit(" is here.\n\n```\ncode\n```\n\n| a | b |\n\n"), F.lit("x" * 1200))
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.posexplode(models.paragraphs(text)).alias("n", "text")).select("doc_id", long("n"), "text")


@query(
    "WITH w AS (SELECT doc_id, k, (doc_id % 7 + k + 1) / 4.0::DOUBLE AS loss, n_chars % 50 + 1 AS tokens FROM documents, (VALUES (0), (1), (2), (3), (4), (5)) v(k)), p AS (SELECT doc_id, exp(sum(loss * tokens) / sum(tokens)) AS p FROM w WHERE k < 4 GROUP BY doc_id) SELECT doc_id, floor(p * 1000 + 0.5) / 1000 AS perplexity, floor(1 / (1 + exp((p - 50) / 22)) * 10000 + 0.5) / 10000 AS machine FROM p"
)
def perplexity(spark, sf_dir):
    """Losses of six windows of every document, of which four count."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("window"), (F.col("n_chars") % 50 + 1).alias("tokens"))
    out = models.perplexity(d.withColumn("loss", (F.col("doc_id") % 7 + F.col("window") + 1) / 4.0))
    return out.select("doc_id", (F.floor(F.col("perplexity") * 1000 + 0.5) / 1000).alias("perplexity"), (F.floor(models.machine_score(F.col("perplexity")) * 10000 + 0.5) / 10000).alias("machine"))


@query("SELECT 'f/' || n_nationkey || '.md' AS other, 'embedding' AS via FROM nation WHERE n_nationkey % 2 = 0")
def associations_of_file(spark, sf_dir):
    """Associations of one file, at whichever end it stands."""
    n = read(spark, sf_dir, "nation").filter(number() % 2 == 0)
    end = lambda path: F.struct(path.alias("path"), F.lit("L1").alias("chunk"), F.lit(1).alias("start"), F.lit(2).alias("end"))
    other, here = end(said("f/", "{n_nationkey}", ".md")), end(F.lit("e.md"))
    rows = n.select(F.when(number() % 4 == 0, here).otherwise(other).alias("a"), F.when(number() % 4 == 0, other).otherwise(here).alias("b"), F.lit(0.5).alias("score"), F.lit("embedding").alias("via"))
    return assoc.of_file(rows, "e.md").filter("a.path = 'e.md'").select(F.col("b.path").alias("other"), "via")


@query("SELECT n_nationkey::BIGINT AS k, v.chunk, n_nationkey % 2 = 0 AS kept FROM nation, (VALUES ('L1'), ('L33')) v(chunk)")
def embedding_cache(spark, sf_dir):
    """Chunks of files of an even key have kept their hash, and so their old vectors; others are embedded anew."""
    n = read(spark, sf_dir, "nation")
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat("n_name", F.lit(" line "), i.cast("string"))), "\n")
    rows = assoc.chunks(n.select(said("f/", "{n_nationkey}", ".md").alias("path"), text.alias("text")))
    key = F.regexp_extract("path", "([0-9]+)", 1).cast("long")
    known = rows.select("path", "chunk", F.when(key % 2 == 0, F.col("hash")).otherwise("old").alias("hash"), F.array(F.lit(9.0)).alias("vector"))
    out = assoc.embedded(rows, lambda texts: [[1.0] for _ in texts], known)
    return out.select(key.alias("k"), "chunk", (F.col("vector")[0] == 9.0).alias("kept"))
