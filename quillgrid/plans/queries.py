"""Queries over the generated tables, one for each operator, and the same in SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrid import ship
from quillgrid.functions import text as T
from quillgrid.functions.config import edit_rules, matches
from quillgrid.operators import assoc, code, detect, grounding, i18n, lexicon, lineage, models, score, segments, site, structure
from quillgrid.plans import prose
from quillgrid.plans.session import accumulated, settled
from quillgrid.sources import files, heatmap, reports, store
from quillgrid.streaming import events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

WORDS = r"regexp_extract_all(text, '[A-Za-z0-9]+(?:[''’\-][A-Za-z0-9]+)*')"
#: Words in a row (repeats take two words each) and adverbs, in SQL.
NOT_ADVERBS = "['only','family','reply','apply','supply','july','italy','ally','rely','multiply','early','ugly','holy','likely','lonely','friendly','daily','weekly','monthly','yearly','silly','jelly','belly','fully']"
REPEATS = r"""
tokens AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word, unnest(g[1:len(w)]) AS gap FROM (
  SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9_]+') AS w, string_split_regex(text, '[A-Za-z0-9_]+') AS g FROM documents)),
marked AS (SELECT *, CASE WHEN lower(word) = lag(lower(word)) OVER d AND regexp_full_match(gap, '\s+') THEN 0 ELSE 1 END AS new FROM tokens WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
islands AS (SELECT doc_id, lower(word) AS word, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM marked),
repeats AS (SELECT doc_id, word, count(*) // 2 AS n FROM islands GROUP BY doc_id, word, island HAVING count(*) >= 2 AND word NOT IN ('that', 'had'))"""
ADVERBS_IN = rf"c AS (SELECT doc_id, len({WORDS}) AS words, len(list_filter(regexp_extract_all(text, '(?i)\b\w{{3,}}ly\b'), lambda x: NOT list_contains({NOT_ADVERBS}, lower(x)))) AS ly FROM documents)"
#: All rules of which SQL knows the findings in the prose of the parts.
RULES = detect.Settings(only=frozenset(prose.STYLES["microsoft"]))


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(ship(spark), sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return run

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that all executors share."""
    settled(spark.range(1))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/scratch-{uuid.uuid4().hex}"


def long(name: str):
    return F.col(name).cast("long").alias(name)


# --- text ---------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, len({WORDS})::BIGINT AS words FROM documents")
def word_count(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.n_words(F.col("text")).alias("words"))


@query(
    r"SELECT doc_id, w >= 100 AND (l > 2000 OR s < w / 200) AS is_data FROM (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]{2,}')) AS w, len(regexp_extract_all(text, '[.!?](\s|$)')) AS s, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS l FROM documents)"
)
def looks_like_data(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", detect.looks_like_data(F.col("text")).alias("is_data"))


@query(
    r"SELECT doc_id, n > 80 AND n * 3 > l AS beyond FROM (SELECT doc_id, len(regexp_extract_all(text, '[\x{3000}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}\x{0400}-\x{04ff}\x{0600}-\x{06ff}\x{0e00}-\x{0e7f}]')) AS n, len(regexp_extract_all(text, '[A-Za-z]')) AS l FROM documents)"
)
def non_latin_filter(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.beyond_latin(F.col("text")).alias("beyond"))


@query(
    "SELECT doc_id, i::BIGINT AS line, (sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(x) - 1)::BIGINT AS start FROM (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
)
def line_offsets(spark, sf_dir):
    return segments.line_offsets(read(spark, sf_dir, "documents")).select("doc_id", long("line"), long("start"))


ABBREVIATIONS = "['mr','mrs','ms','dr','prof','sr','jr','st','vs','etc','inc','ltd','co','no','fig','al','eg','ie','e.g','i.e','u.s','u.k','a.m','p.m','approx']"


@query(
    rf"""WITH p AS (SELECT doc_id, unnest(string_split_regex(text, '\n\s*\n')) AS x FROM documents),
e AS (SELECT doc_id, x, list_transform(regexp_extract_all(x, '([A-Za-z.]*)[.!?]+["'')\]”’]?(?:\s+|$)', 1), lambda w: NOT list_contains({ABBREVIATIONS}, rtrim(lower(w), '.'))) AS kept,
  NOT regexp_matches(x, '[.!?]["'')\]”’]?\s*$') AS loose FROM p WHERE trim(x, ' ' || chr(10) || chr(9) || chr(13)) <> '')
SELECT doc_id, sum(len(list_filter(kept, lambda k: k)) + CASE WHEN loose OR NOT kept[len(kept)] THEN 1 ELSE 0 END)::BIGINT AS sentences FROM e GROUP BY doc_id"""
)
def sentences(spark, sf_dir):
    return grounding.claims(read(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("sentences"))


SPEECH = """'(' || n_name || ' is here. Mr. X of ' || n_name || ' came! "Did it?"' || chr(10) || 'Yes' || chr(10) || chr(10) || '# A title. Not one' || chr(10) || '- ' || n_name || ' went.'"""


@query(
    """WITH n AS (SELECT n_nationkey::BIGINT AS doc_id, n_name AS x, length(n_name)::BIGINT AS k FROM nation)
SELECT doc_id, 0::BIGINT AS n, 0::BIGINT AS start, 1::BIGINT AS line, '(' || x || ' is here.' AS text FROM n UNION ALL SELECT doc_id, 1, k + 11, 1, 'Mr. X of ' || x || ' came!' FROM n
UNION ALL SELECT doc_id, 2, 2 * k + 27, 1, '"Did it?"' FROM n UNION ALL SELECT doc_id, 3, 2 * k + 37, 2, 'Yes' FROM n UNION ALL SELECT doc_id, 4, 2 * k + 61, 5, '- ' || x || ' went.' FROM n"""
)
def sentence_places(spark, sf_dir):
    text = F.expr(SPEECH.replace("chr(10)", "chr(10)"))
    docs = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), text.alias("text"))
    return grounding.claims(docs).select("doc_id", long("n"), long("start"), long("line"), "text")


@query()
def document_parts(spark, sf_dir):
    return segments.segmented(read(spark, sf_dir, "documents"))


@query(
    """WITH n AS (SELECT n_regionkey::BIGINT AS doc_id, n_nationkey AS k, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, count(*) OVER (PARTITION BY n_regionkey) AS m FROM nation)
SELECT doc_id, 'item' AS part, 4 + i AS line, '**' || n_name || '**: one nation of it' AS text FROM n UNION ALL SELECT doc_id, 'link', k, 'the nation' FROM n
UNION ALL SELECT DISTINCT r_regionkey::BIGINT, 'heading', v.line + CASE WHEN v.late THEN m ELSE 0 END, coalesce(v.text, r_name) FROM region JOIN (SELECT DISTINCT doc_id, m FROM n) ON doc_id = r_regionkey, (VALUES (1, false, NULL), (3, false, 'Nations'), (6, true, 'Overview'), (10, true, 'Overview')) v(line, late, text)"""
)
def markdown_places(spark, sf_dir):
    out = segments.segmented(markdown(spark, sf_dir))
    key = F.regexp_extract("x.target", "nations/([0-9]+)", 1)
    rows = out.select("doc_id", F.lit("heading").alias("part"), F.explode("headings").alias("x")).select("doc_id", "part", F.col("x.line").cast("long").alias("line"), "x.text")
    rows = rows.union(out.select("doc_id", F.lit("item").alias("part"), F.explode("items").alias("x")).select("doc_id", "part", F.col("x.line").cast("long"), "x.text"))
    return rows.union(out.select("doc_id", F.lit("link").alias("part"), F.explode("links").alias("x")).select("doc_id", "part", key.cast("long"), "x.text"))


@query(
    """WITH n AS (SELECT n_nationkey::BIGINT AS doc_id, n_name AS x, length(n_name)::BIGINT AS k FROM nation)
SELECT doc_id, 0::BIGINT AS n, '# ' || x || chr(10) || '- A b' || chr(10) AS prompt, k + 4 AS start FROM n UNION ALL SELECT doc_id, 1, '# ' || x || chr(10) || '- A b' || chr(10) || '- C ' || x || chr(10), k + 12 FROM n
UNION ALL SELECT doc_id, 2, '# ' || x || chr(10) || 'One text.' || chr(10), 2 * k + 18 FROM n UNION ALL SELECT doc_id, 3, '# ' || x || chr(10) || 'Two.' || chr(10), 2 * k + 28 FROM n"""
)
def query_items(spark, sf_dir):
    text = F.expr("'# ' || n_name || '\\n\\n- A b\\n  - C ' || n_name || '\\n\\nOne text. Two.\\n'")
    docs = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), text.alias("text"))
    return segments.queries(docs, True).select("doc_id", long("n"), "prompt", long("start"))


@query("SELECT r_regionkey::BIGINT AS doc_id, 4::BIGINT AS headings, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey)::BIGINT AS items, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey)::BIGINT AS links, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey)::BIGINT AS bold FROM region")
def markdown_parts(spark, sf_dir):
    out = segments.segmented(markdown(spark, sf_dir))
    return out.select("doc_id", *[F.size(c).cast("long").alias(c) for c in ("headings", "items", "links", "bold")])


@query()
def reading_grades(spark, sf_dir):
    return segments.readability(read(spark, sf_dir, "documents"))


# --- detector -----------------------------------------------------------------------------------------------


def findings(spark, sf_dir, settings=RULES) -> DataFrame:
    return detect.detected(read(spark, sf_dir, "documents"), settings)


@query("WITH " + REPEATS + " SELECT doc_id, sum(n)::BIGINT AS n FROM repeats GROUP BY doc_id")
def repeated_word(spark, sf_dir):
    return findings(spark, sf_dir, detect.Settings(only=frozenset(["repeated-word"]))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"WITH {ADVERBS_IN} SELECT doc_id FROM c WHERE ly >= 5 AND ly / greatest(words, 1) * 1000 >= 25")
def adverb_overuse(spark, sf_dir):
    return findings(spark, sf_dir, detect.Settings(only=frozenset(["adverb-overuse"]))).select("doc_id")


@query(r"SELECT doc_id, n FROM (SELECT doc_id, (len(regexp_extract_all(text, '\w!')) - len(regexp_extract_all(text, '\w!=')))::BIGINT AS n FROM documents) WHERE n > 0")
def exclamation(spark, sf_dir):
    return findings(spark, sf_dir, detect.Settings("google", only=frozenset(["no-exclamation"]))).groupBy("doc_id").agg(F.count("*").alias("n"))


def counted(style: str):
    """The findings of each rule of a style in every document of the parts' prose."""

    def run(spark, sf_dir):
        docs = prose.documents(read(spark, sf_dir, "part"))
        return detect.detected(docs, detect.Settings(style, only=frozenset(prose.STYLES[style]))).groupBy("doc_id", "rule_id").agg(F.count("*").alias("n"))

    run.__name__ = f"rules_{style}"
    return run


for _style in prose.STYLES:
    query(prose.sql(_style))(counted(_style))


def written(spark, sf_dir) -> DataFrame:
    return prose.documents(read(spark, sf_dir, "part"))


@query(prose.findings_sql() + " SELECT doc_id, rule_id, family, severity, n FROM f")
def finding_levels(spark, sf_dir):
    return detect.detected(written(spark, sf_dir), RULES).groupBy("doc_id", "rule_id", "family", "severity").agg(F.count("*").alias("n"))


@query("SELECT doc_id, n FROM (SELECT doc_id, len(regexp_extract_all(t, '(?i)\\b(?:boldly|sadly|home)\\b'))::BIGINT AS n FROM (" + prose.texts_sql() + ")) WHERE n >= 2")
def adverb_list(spark, sf_dir):
    s = detect.Settings(only=frozenset(["microsoft-adverbs"]), adverbs=frozenset(["boldly", "sadly", "home"]))
    return detect.detected(written(spark, sf_dir), s).groupBy("doc_id").agg(F.count("*").alias("n"))


#: Structures by key modulo 11, and the rules that each is against.
SHAPES = (
    ("- a b\n- c\n- d\n- e\n- f", ("listicle-reflex",)),
    ("- a b\n- c\n- d\n- e\n- f\n- g\n- h\n- i", ("listicle-reflex", "bullet-overuse")),
    ("**Bold head line**\n\nText.", ("emphasis-as-heading",)),
    ("Text.\n\n```\ncode\n```\n\n```py\ncode\n```\n", ("fenced-code-language",)),
    ("The API is up. The api is down.", ("acronym-case",)),
    ("The Big Cat sat. A big cat sat.", ("inconsistent-capitalization",)),
    ("Text.\n\n---\n\n# Head", ("thematic-break-before-heading",)),
    ("[a]: http://x.org\n[b]: http://y.org\n\nText [b].", ("unused-named-ref",)),
    ("We sign in here. Then log in there.", ("terminology-consistency",)),
    ("One cat sat there. Two dogs ran home. Ten birds flew off. Six men went by. Old fish swam on. New days came up.", ("uniform-cadence",)),
    ("Text of a plain kind.\n\n- a longer item of many words in it\n", ()),
)


@query("SELECT n_nationkey::BIGINT AS doc_id, rule_id, 1::BIGINT AS n FROM nation JOIN (VALUES " + ", ".join(f"({k}, '{r}')" for k, (_, rules) in enumerate(SHAPES) for r in rules) + f") v(k, rule_id) ON n_nationkey % {len(SHAPES)} = k")
def structure_rules(spark, sf_dir):
    text = F.element_at(F.array(*[F.lit(t) for t, _ in SHAPES]), (F.col("n_nationkey") % len(SHAPES) + 1).cast("int"))
    docs = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), text.alias("text"))
    return detect.detected(docs, detect.Settings(only=frozenset(r for _, rules in SHAPES for r in rules))).groupBy("doc_id", "rule_id").agg(F.count("*").alias("n"))


#: Two texts of 32 words: of one syllable each, and of nine a pair (-io- counts as two).
EASY, HARD = ("The cat sat on the mat and ran. " * 4).strip(), ("Information technology " * 16).strip() + "."


@query(
    "SELECT n_nationkey::BIGINT AS doc_id, v.words, v.sentences, v.syllables, floor(((0.39 * v.words / v.sentences + 11.8 * v.syllables / v.words - 15.59) + (0.0588 * v.letters / v.words * 100 - 0.296 * v.sentences / v.words * 100 - 15.8)) / 2 * 1000 + 0.5) / 1000 AS grade, v.fires FROM nation JOIN (VALUES (0, 32::BIGINT, 4::BIGINT, 32::BIGINT, 92::BIGINT, false), (1, 32::BIGINT, 1::BIGINT, 144::BIGINT, 336::BIGINT, true)) v(k, words, sentences, syllables, letters, fires) ON n_nationkey % 2 = k"
)
def reading_levels(spark, sf_dir):
    docs = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.when(F.col("n_nationkey") % 2 == 0, EASY).otherwise(HARD).alias("text"))
    found = detect.detected(docs, detect.Settings("plain", only=frozenset(["reading-grade"]))).select(F.col("doc_id").alias("of"))
    rows = segments.readability(docs).join(found, F.col("doc_id") == F.col("of"), "left")
    return rows.select("doc_id", long("words"), long("sentences"), long("syllables"), T.rounded(F.col("grade"), 3).alias("grade"), F.col("of").isNotNull().alias("fires"))


@query(r"SELECT doc_id, n FROM (SELECT doc_id, len(regexp_extract_all(text, '(?i)\b(?:above|accessible|actionable|against|alarm|alert|alias|allow|allows|and/or|as well as|assure|author|avg|beta|ensure|he|insure|sample|she)\b'))::BIGINT AS n FROM documents) WHERE n >= 2")
def az_word_list(spark, sf_dir):
    return findings(spark, sf_dir, detect.Settings(only=frozenset(["ms-vocab-az-wordlist"]))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query()
def findings_all(spark, sf_dir):
    return findings(spark, sf_dir, detect.Settings())


@query()
def findings_google(spark, sf_dir):
    return findings(spark, sf_dir, detect.Settings("google"))


@query("WITH " + REPEATS + " SELECT doc_id, sum(n)::BIGINT AS n FROM repeats WHERE NOT contains(word, 'the') GROUP BY doc_id")
def value_ignore(spark, sf_dir):
    rows = findings(spark, sf_dir, detect.Settings(only=frozenset(["repeated-word"])))
    values = spark.createDataFrame([("repeated-word", "The")], "rule_id string, value string")
    return detect.without_values(rows, values).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("WITH " + REPEATS + " SELECT doc_id, sum(n)::BIGINT AS n FROM repeats GROUP BY doc_id")
def finding_dedupe(spark, sf_dir):
    rows = findings(spark, sf_dir, detect.Settings(only=frozenset(["repeated-word"])))
    twice = rows.union(rows.withColumn("seq", F.col("seq") + 1))
    return detect.deduplicated(twice).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(prose.findings_sql() + " SELECT sum(CASE severity WHEN 'error' THEN n ELSE 0 END)::BIGINT AS error, sum(CASE severity WHEN 'warn' THEN n ELSE 0 END)::BIGINT AS warn, sum(CASE severity WHEN 'advisory' THEN n ELSE 0 END)::BIGINT AS advisory FROM f")
def severity_totals(spark, sf_dir):
    return detect.summary(detect.detected(written(spark, sf_dir), RULES))


@query(prose.findings_sql() + " SELECT rule_id, sum(n)::BIGINT AS n FROM f GROUP BY rule_id ORDER BY n DESC, rule_id LIMIT 15")
def rule_histogram(spark, sf_dir):
    return detect.histogram(detect.detected(written(spark, sf_dir), RULES))


@query(prose.findings_sql() + " SELECT doc_id, sum(n)::BIGINT AS n, sum(CASE severity WHEN 'error' THEN n ELSE 0 END)::BIGINT AS errors FROM f GROUP BY doc_id ORDER BY errors DESC, n DESC, doc_id LIMIT 12")
def worst_files(spark, sf_dir):
    return detect.worst(detect.detected(written(spark, sf_dir), RULES))


@query(prose.findings_sql() + " SELECT doc_id, family, sum(n)::BIGINT AS n FROM f GROUP BY ALL")
def family_counts(spark, sf_dir):
    return score.by_family(detect.detected(written(spark, sf_dir), RULES))


#: Weights, signals of a person and score of every document of the prose.
SCORES = (
    prose.findings_sql()
    + r""", t AS ("""
    + prose.texts_sql()
    + r"""),
g AS (SELECT doc_id, sum(n)::BIGINT AS findings, sum(n * CASE severity WHEN 'error' THEN 3.0::DOUBLE WHEN 'warn' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END * CASE family WHEN 'ai-slop' THEN 1.0::DOUBLE WHEN 'inclusive' THEN 0.5::DOUBLE WHEN 'clarity' THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END) AS weighted FROM f GROUP BY doc_id),
m AS (SELECT t.doc_id, w, coalesce(findings, 0)::BIGINT AS findings, coalesce(weighted, 0) / w * 1000 AS d, len(regexp_extract_all(t, '(?i)\b\w+[''’](?:t|s|re|ve|ll|d|m)\b'))::BIGINT AS con, len(regexp_extract_all(t, '\b(?:I(?:[''’](?:m|ve|ll|d))?|[Ww]e(?:[''’](?:re|ve|ll|d))?|[Mm]y|[Oo]ur|[Mm]e|[Uu]s)\b'))::BIGINT AS fp FROM t LEFT JOIN g ON g.doc_id = t.doc_id),
h AS (SELECT *, least(15.0::DOUBLE, (con + fp) / w * 1000 * 1.5::DOUBLE) AS h FROM m),
s AS (SELECT *, floor(greatest(0.0::DOUBLE, least(100.0::DOUBLE, greatest(0.0::DOUBLE, 100 * (1 - exp(-d / 35)) - h))) + 0.5)::BIGINT AS score FROM h)"""
)


SCORE_ROWS = SCORES + " SELECT doc_id, w::BIGINT AS words, findings, con AS contractions, fp AS first_person, floor(d * 10000 + 0.5) / 10000 AS density, floor(h * 10000 + 0.5) / 10000 AS discount, score FROM s"


@query(SCORE_ROWS)
def score_documents(spark, sf_dir):
    docs = written(spark, sf_dir)
    return score.scored(docs, detect.detected(docs, RULES)).drop("band")


@query(SCORE_ROWS)
def score_in_one_pass(spark, sf_dir):
    return score.detected_scores(written(spark, sf_dir), RULES).drop("band")


@query(SCORES + " SELECT CASE WHEN score >= 60 THEN 'heavy' WHEN score >= 30 THEN 'moderate' WHEN score >= 12 THEN 'light' ELSE 'clean' END AS band, count(*)::BIGINT AS n FROM s GROUP BY band")
def score_bands(spark, sf_dir):
    docs = written(spark, sf_dir)
    return score.scored(docs, detect.detected(docs, RULES)).groupBy("band").agg(F.count("*").alias("n"))


@query(SCORES + " SELECT doc_id, doc_id || ': ' || score || '/100 (' || CASE WHEN score >= 60 THEN 'heavy' WHEN score >= 30 THEN 'moderate' WHEN score >= 12 THEN 'light' ELSE 'clean' END || '), ' || findings || ' findings in ' || w || ' words' AS text FROM s")
def score_lines(spark, sf_dir):
    docs = written(spark, sf_dir)
    return reports.score_lines(score.scored(docs, detect.detected(docs, RULES)))


@query()
def json_report(spark, sf_dir):
    return files.documents_report(read(spark, sf_dir, "documents"))


@query()
def human_report(spark, sf_dir):
    return reports.documents_lines(read(spark, sf_dir, "documents"))


@query()
def agent_report(spark, sf_dir):
    return reports.documents_for_agent(read(spark, sf_dir, "documents"), exemplars=spark.createDataFrame([("repeated-word", "the the", "the")], "rule_id string, bad string, good string"))


#: The same reports of the prose, as their counts and first lines.
HEADS = " SELECT doc_id, doc_id || ': ' || sum(n) || ' findings (' || sum(CASE severity WHEN 'error' THEN n ELSE 0 END) || ' error, ' || sum(CASE severity WHEN 'warn' THEN n ELSE 0 END) || ' warn, ' || sum(CASE severity WHEN 'advisory' THEN n ELSE 0 END) || ' advisory)' AS head, sum(n)::BIGINT AS lines FROM f GROUP BY doc_id"


@query(prose.findings_sql() + HEADS)
def human_report_heads(spark, sf_dir):
    out = reports.documents_lines(written(spark, sf_dir), RULES)
    return out.select("doc_id", F.split("text", "\n")[0].alias("head"), (F.size(F.split("text", "\n")) - 1).cast("long").alias("lines"))


@query(prose.findings_sql() + " SELECT doc_id, least(sum(n), 10)::BIGINT AS shown, greatest(sum(n) - 10, 0)::BIGINT AS more, max(CASE severity WHEN 'error' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END)::BIGINT AS worst FROM f GROUP BY doc_id")
def agent_report_counts(spark, sf_dir):
    out = reports.documents_for_agent(written(spark, sf_dir), RULES)
    first = F.regexp_extract("text", "^  L[0-9]+ ([a-z]+)", 1)
    return out.select(
        "doc_id", F.regexp_count("text", F.lit("(?m)^  L[0-9]+ ")).cast("long").alias("shown"), F.coalesce(F.expr("try_cast(regexp_extract(text, '[(]([0-9]+) more[)]', 1) AS bigint)"), F.lit(0)).alias("more"), F.when(first == "error", 2).when(first == "warn", 1).otherwise(0).cast("long").alias("worst")
    )


@query(SCORES + " SELECT doc_id, score, findings AS n FROM s")
def json_report_counts(spark, sf_dir):
    out = files.documents_report(written(spark, sf_dir), RULES).withColumn("j", F.from_json("json", "struct<score:bigint,findings:array<struct<rule:string>>>"))
    return out.select("doc_id", F.col("j.score").alias("score"), F.size("j.findings").cast("long").alias("n"))


@query("SELECT family, n::BIGINT AS n FROM (VALUES ('ai-slop', 31), ('clarity', 13), ('style', 110), ('inclusive', 17)) t(family, n)")
def rule_registry(spark, sf_dir):
    return detect.registry(spark).groupBy("family").agg(F.count("*").alias("n"))


# --- word lists ---------------------------------------------------------------------------------------------

LEXICON = [("the", 1.0, "a"), ("and", 2.0, "plus"), ("with", 4.0, "using"), ("he", 8.0, "they"), ("der", 1.5, "die")]
VALUES = "lex(word, weight, \"to\") AS (VALUES " + ", ".join(f"('{w}', {x}::DOUBLE, '{t}')" for w, x, t in LEXICON) + ")"
TOKENS = "tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS word FROM documents)"


def lex(spark):
    return spark.createDataFrame(LEXICON, "word string, weight double, to string")


@query(f"WITH {VALUES}, {TOKENS} SELECT doc_id, word, count(*)::BIGINT AS n FROM tok JOIN lex USING (word) GROUP BY doc_id, word")
def lexicon_hits(spark, sf_dir):
    return lexicon.hits(read(spark, sf_dir, "documents"), lex(spark)).select("doc_id", "word", "n")


@query(f"WITH {VALUES}, {TOKENS} SELECT doc_id, word, \"to\" AS use, count(*)::BIGINT AS n FROM tok JOIN lex USING (word) WHERE weight >= 2 GROUP BY ALL")
def avoid_use_map(spark, sf_dir):
    return lexicon.hits(read(spark, sf_dir, "documents"), lex(spark).filter("weight >= 2")).select("doc_id", "word", F.col("to").alias("use"), "n")


@query(
    f"""WITH {VALUES}, {TOKENS}, h AS (SELECT doc_id, count(*) AS hits, count(DISTINCT word) AS kinds, sum(weight) AS w FROM tok JOIN lex USING (word) GROUP BY doc_id),
r AS (SELECT doc_id, hits, kinds, hits * 1000 / n AS density, w * 1000 / n AS weighted FROM h JOIN (SELECT doc_id, greatest(len({WORDS}), 1) AS n FROM documents) USING (doc_id))
SELECT doc_id, hits::BIGINT AS hits, kinds::BIGINT AS kinds, floor(density * 10000 + 0.5) / 10000 AS density, floor(weighted * 10000 + 0.5) / 10000 AS weighted FROM r WHERE kinds >= 3 OR hits >= 2 AND density >= 40"""
)
def overused_weighted(spark, sf_dir):
    out = lexicon.dense(read(spark, sf_dir, "documents"), lex(spark), 3, 2, 40.0)
    return out.select("doc_id", "hits", "kinds", T.rounded(F.col("density")).alias("density"), T.rounded(F.col("weighted")).alias("weighted"))


# --- markdown made of the small tables ----------------------------------------------------------------------


def markdown(spark, sf_dir) -> DataFrame:
    """A page for each region: a title, a section two levels down, an overview twice, its nations as labelled items, and a link to each."""
    n = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    r = read(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"))
    items = F.array_join(F.transform("n", lambda x: F.concat(F.lit("- **"), x["n_name"], F.lit("**: one nation of it"))), "\n")
    links = F.array_join(F.transform("n", lambda x: F.concat(F.lit("See [the nation]("), F.lit("nations/"), x["n_nationkey"], F.lit(".md#"), F.lower(x["n_name"]), F.lit(")."))), "\n")
    text = F.concat(F.lit("# "), "r_name", F.lit("\n\n### Nations\n\n"), items, F.lit("\n\n## Overview\n\nOne text.\n\n## Overview\n\n"), links, F.lit("\n"))
    return r.select(F.col("r_regionkey").cast("long").alias("doc_id"), text.alias("text"), F.concat(F.lit("docs/region-"), "r_regionkey", F.lit(".md")).alias("path"))


MD = detect.Settings(only=frozenset(["skipped-heading", "duplicate-heading", "bold-lead-in-list"]))


@query(
    "SELECT r_regionkey::BIGINT AS doc_id, rule_id, 1::BIGINT AS n FROM region, (VALUES ('skipped-heading'), ('duplicate-heading')) v(rule_id) UNION ALL SELECT n_regionkey::BIGINT, 'bold-lead-in-list', 1::BIGINT FROM nation GROUP BY n_regionkey HAVING count(*) >= 3"
)
def heading_and_list_rules(spark, sf_dir):
    return detect.detected(markdown(spark, sf_dir), MD).groupBy("doc_id", "rule_id").agg(F.count("*").alias("n"))


def site_tree(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Pages of regions and of all nations: those of an odd key lie in another folder than links say, and the heading of those with a key divisible by four is another."""
    n = read(spark, sf_dir, "nation")
    title = F.when(F.col("n_nationkey") % 4 == 0, F.lit("Elsewhere")).otherwise(F.col("n_name"))
    place = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "docs/nations/").otherwise("docs/lands/"), F.col("n_nationkey"), F.lit(".md"))
    pages = markdown(spark, sf_dir).select("path", "text").union(n.select(place, F.concat(F.lit("# "), title, F.lit("\n\nText.\n"))))
    return pages, pages.select("path").union(spark.createDataFrame([("README.md",), ("LICENSE",), ("mkdocs.yml",)], "path string"))


@query(
    "SELECT rule_id, file, count(*)::BIGINT AS n FROM (SELECT CASE WHEN n_nationkey % 2 = 1 THEN 'link-broken' ELSE 'link-broken-anchor' END AS rule_id, 'docs/region-' || n_regionkey || '.md' AS file FROM nation WHERE n_nationkey % 4 <> 2) GROUP BY ALL UNION ALL SELECT 'community-missing-file', '(project)', 4::BIGINT"
)
def site_check(spark, sf_dir):
    pages, paths = site_tree(spark, sf_dir)
    return site.check_site(pages, paths).groupBy("rule_id", "file").agg(F.count("*").alias("n"))


@query(
    "SELECT 'nav-missing-target' AS rule_id, 'mkdocs.yml' AS file, 'docs/gone.md' AS span UNION ALL SELECT 'nav-orphan-page', p, p FROM (SELECT 'docs/region-' || r_regionkey || '.md' AS p FROM region WHERE r_regionkey <> 0 UNION ALL SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'docs/nations/' ELSE 'docs/lands/' END || n_nationkey || '.md' FROM nation)"
)
def site_navigation(spark, sf_dir):
    pages, paths = site_tree(spark, sf_dir)
    nav = spark.createDataFrame([("mkdocs.yml", "site_name: x\nnav:\n  - Home: region-0.md\n  - Gone: gone.md\n")], "path string, text string")
    return site.check_nav(pages.union(nav), paths).select("rule_id", "file", "span")


@query("SELECT 'mkdocs' AS id")
def platforms(spark, sf_dir):
    return structure.platforms(site_tree(spark, sf_dir)[1]).select("id")


@query(
    "SELECT v.folder || n_name || '.md' AS path, v.type, w.span FROM nation JOIN (VALUES (0, 'docs/adr/', 'adr'), (1, 'runbooks/', 'runbook'), (2, 'rfcs/', 'rfc'), (4, 'incidents/', 'postmortem')) v(k, folder, type) ON n_nationkey % 5 = v.k JOIN (VALUES ('adr', 'Status'), ('adr', 'Consequences'), ('adr', 'Considered Options'), ('runbook', 'Prerequisites'), ('runbook', 'Steps'), ('runbook', 'Rollback'), ('runbook', 'Escalation'), ('runbook', 'Validation'), ('rfc', 'Alternatives'), ('rfc', 'Drawbacks'), ('rfc', 'Non-goals'), ('rfc', 'Unresolved Questions'), ('postmortem', 'Impact'), ('postmortem', 'Timeline'), ('postmortem', 'Root Cause'), ('postmortem', 'Action Items'), ('postmortem', 'Lessons Learned'), ('postmortem', 'Resolution')) w(type, span) ON v.type = w.type"
)
def asset_types(spark, sf_dir):
    body = "\n\n## Summary\n\n## Context\n\n## Decision\n\n## Rollout\n\n## Trigger warning\n"
    more = F.when(F.col("n_nationkey") % 5 == 1, "\n## When to use\n").when(F.col("n_nationkey") % 5 == 2, "\n## Problem\n").when(F.col("n_nationkey") % 5 == 4, "\n## Detection\n").otherwise("")
    rows = read(spark, sf_dir, "nation").select(F.concat(F.element_at(F.array(*map(F.lit, ("docs/adr/", "runbooks/", "rfcs/", "notes/", "incidents/"))), F.col("n_nationkey") % 5 + 1), "n_name", F.lit(".md")).alias("path"), F.concat(F.lit("# "), "n_name", F.lit(body), more).alias("text"))
    return structure.assets(rows).select("path", "type", F.explode("findings").alias("f")).select("path", "type", "f.span")


# --- facts --------------------------------------------------------------------------------------------------


def parts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A claim for each part, on its price or the year of its launch, and a fact on it for four of five; every seventh fact is another.  Parts without a fact are spoken of in words that no fact has."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    name, kind = F.concat(F.lit("Part Number"), k), F.lower("p_type")
    said = lambda x: F.when(k % 3 == 0, F.concat(F.lit("The "), name, F.lit(" launch of "), kind, F.lit(" was in "), (F.lit(1950) + x % 60))).otherwise(F.concat(F.lit("The "), name, F.lit(" catalog price of "), kind, F.lit(" is $"), x + 100))
    none = F.concat(F.lit("Some purple birds near zq"), k, F.lit(" sang 7 songs today."))
    docs = p.select(k.alias("doc_id"), F.when(k % 5 == 0, none).otherwise(F.concat(said(k), F.lit(" there."))).alias("text"))
    wrong = F.when(k % 7 == 0, k + 1).otherwise(k)
    fact = p.filter(k % 5 != 0).select(k.alias("fact"), F.concat(said(wrong), F.lit(".")).alias("text"), F.lit(None).cast("string").alias("source"))
    return docs, fact


@query(
    "SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 5 = 0 THEN 'unsupported-claim' WHEN p_partkey % 3 = 0 THEN 'number-date-mismatch' ELSE 'contradicts-fact' END AS rule_id, CASE WHEN p_partkey % 5 = 0 THEN 'advisory' ELSE 'error' END AS severity FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 7 = 0"
)
def factcheck_contradictions(spark, sf_dir):
    return grounding.checked(*parts(spark, sf_dir)).select("doc_id", "rule_id", "severity")


@query(
    "WITH c AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS r, p_partkey AS k FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 7 = 0) SELECT k AS doc_id, row_number() OVER (ORDER BY r, k)::BIGINT AS place FROM c"
)
def factcheck_order(spark, sf_dir):
    """All claims as sentences of one document, so that the order of its findings shows."""
    found = grounding.checked(*parts(spark, sf_dir)).select(F.lit(0).alias("doc"), "severity", F.col("doc_id").alias("line"), "seq")
    rank = F.row_number().over(Window.partitionBy("doc").orderBy(F.when(F.col("severity") == "error", 0).otherwise(1), "line"))
    ordered = grounding.in_report_order(found, "doc").limit(1 << 30)
    return ordered.select(F.col("line").alias("doc_id"), rank.cast("long").alias("place"))


@query("SELECT row_number() OVER (ORDER BY n_nationkey, v.k)::BIGINT AS fact, replace(v.t, '?', n_name) AS text FROM nation, (VALUES (0, '? is old.'), (1, 'It has ? men!')) v(k, t)")
def facts_of_documents(spark, sf_dir):
    docs = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.concat(F.lit("# T\n\n"), "n_name", F.lit(" is old. It has "), "n_name", F.lit(" men!")).alias("text"))
    return grounding.facts_of_document(docs).select((F.col("fact") + 1).alias("fact"), "text")


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9](?:[0-9.]*[0-9])?\\s?%'))::BIGINT AS n FROM documents WHERE regexp_matches(text, '[0-9]\\s?%')")
def percent_spans(spark, sf_dir):
    rows = grounding.claims(read(spark, sf_dir, "documents").filter(F.col("text").rlike(r"[0-9]\s?%")))
    return rows.groupBy("doc_id").agg(F.sum(F.size(F.filter("spans", lambda s: s["kind"] == "percent"))).alias("n"))


# --- chunks and vectors -------------------------------------------------------------------------------------


@query(
    r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), k AS (SELECT doc_id, l, unnest(generate_series(0, greatest(0, ceil((len(l) - 40) / 32))::BIGINT)) AS k FROM l),
c AS (SELECT doc_id, k * 32 + 1 AS a, least(k * 32 + 40, len(l)) AS b, regexp_replace(array_to_string(l[k * 32 + 1 : k * 32 + 40], chr(10)), '^\s+|\s+$', '', 'g') AS t FROM k)
SELECT doc_id, a::BIGINT AS start, b::BIGINT AS "end", least(length(t), 2000)::BIGINT AS size FROM c WHERE length(t) >= 40"""
)
def chunk_windows(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    return assoc.chunks(rows).select(F.col("path").alias("doc_id"), long("start"), long("end"), F.length("text").cast("long").alias("size"))


def vectors(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), "embedding", F.col("embedding").cast("array<double>").alias("vector"))


def floats(spark, sf_dir) -> DataFrame:
    """Vectors as they are stored, which are half as much to shuffle."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.col("embedding").alias("vector"))


NEAR = "near AS (SELECT a.vec_id AS id, b.vec_id AS other, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a, embeddings b WHERE a.label <> b.label AND list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.35 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) <= 8)"


@query(f"WITH {NEAR} SELECT id, other, floor(sim * 10000 + 0.5) / 10000 AS sim FROM near")
def knn_topk(spark, sf_dir):
    return assoc.neighbours(floats(spark, sf_dir)).select("id", "other", T.rounded(F.col("sim")).alias("sim"))


@query(f"WITH {NEAR} SELECT least(id, other) AS a, greatest(id, other) AS b, floor(max(sim) * 10000 + 0.5) / 10000 AS sim FROM near GROUP BY ALL")
def knn_pairs(spark, sf_dir):
    return assoc.pairs(assoc.neighbours(floats(spark, sf_dir))).select("a", "b", T.rounded(F.col("sim")).alias("sim"))


QUERY = [1.0 if k % 2 else 0.5 for k in range(64)]
SIM = "list_dot_product(embedding::DOUBLE[], [" + ", ".join(f"{x}::DOUBLE" for x in QUERY) + "])"


@query(f"SELECT vec_id AS id, label AS grp, floor({SIM} * 10000 + 0.5) / 10000 AS sim FROM embeddings WHERE label <> 3 ORDER BY {SIM} DESC, vec_id LIMIT 10")
def vector_search(spark, sf_dir):
    return assoc.search(vectors(spark, sf_dir), QUERY, 10, 3).select("id", "grp", T.rounded(F.col("sim")).alias("sim"))


@query(
    f"WITH h AS (SELECT vec_id AS id, label AS grp, {SIM} AS sim FROM embeddings ORDER BY {SIM} DESC, vec_id LIMIT 64) SELECT id, grp, floor(sim * 10000 + 0.5) / 10000 AS sim FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY sim DESC, id) > 1 AS over_ FROM h) ORDER BY over_, sim DESC, id LIMIT 8"
)
def search_cap_per_file(spark, sf_dir):
    return assoc.capped(assoc.search(vectors(spark, sf_dir), QUERY, 64), 8, 1).select("id", "grp", T.rounded(F.col("sim")).alias("sim"))


@query(
    "WITH u AS (SELECT label, generate_subscripts(embedding, 1) AS p, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, p, avg(x) AS x FROM u GROUP BY ALL) SELECT label AS grp, p::BIGINT AS p, floor(x / sqrt(sum(x * x) OVER (PARTITION BY label)) * 10000 + 0.5) / 10000 AS x FROM m"
)
def mean_vector(spark, sf_dir):
    out = assoc.mean_vectors(vectors(spark, sf_dir)).select("grp", F.posexplode("vector").alias("p", "x"))
    return out.select("grp", (F.col("p") + 1).cast("long").alias("p"), T.rounded(F.col("x")).alias("x"))


def tree(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.concat(F.lit("bench/"), "item_id", F.lit(".md")).alias("path"), F.concat("text", F.lit("\n"), "text").alias("text"))


def letters(texts: list[str]) -> list[list[float]]:
    """Shares of the letters a to z in each text, of length 1: a stand-in for a model that SQL can follow."""
    out = []
    for t in texts:
        v = [float(t.lower().count(chr(97 + k))) for k in range(26)]
        norm = sum(x * x for x in v) ** 0.5
        out.append([x / norm for x in v] if norm else v)
    return out


#: Neighbours of the files' chunks (one each) by letters.
LETTERS = "list_transform(range(97, 123), lambda k: (length(lower(t)) - length(replace(lower(t), chr(k::INT), '')))::DOUBLE)"
PAIRS = f"""v AS (SELECT path, list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) AS x FROM (SELECT path, {LETTERS} AS x FROM t)),
near AS (SELECT a.path AS p, b.path AS q, list_dot_product(a.x, b.x) AS sim FROM v a, v b WHERE a.path <> b.path QUALIFY row_number() OVER (PARTITION BY a.path ORDER BY sim DESC) <= 8)"""
BENCH = "t AS (SELECT 'bench/' || item_id || '.md' AS path, text || chr(10) || text AS t FROM benchmark)"


@query(f"WITH {BENCH}, {PAIRS} SELECT least(p, q) AS a, greatest(p, q) AS b, floor(max(sim) * 1000 + 0.5) / 1000 AS score FROM near GROUP BY ALL")
def associations(spark, sf_dir):
    out = assoc.associations(assoc.embedded(assoc.chunks(tree(spark, sf_dir)), letters))
    return assoc.ranked(out).select(F.col("a.path").alias("a"), F.col("b.path").alias("b"), "score")


@query(
    f"""WITH b AS (SELECT item_id AS k, 'bench/' || item_id || '.md' AS path, text || chr(10) || text AS t FROM benchmark), was AS (SELECT path, t FROM b), now AS (SELECT k, path, CASE WHEN k % 5 = 1 THEN 'New text of this file. ' || t ELSE t END AS t FROM b WHERE k % 5 <> 0),
o AS (SELECT * FROM (WITH t AS (SELECT path, t FROM was), {PAIRS} SELECT least(p, q) AS a, greatest(p, q) AS b, max(sim) AS sim FROM near GROUP BY ALL)),
m AS (SELECT * FROM (WITH t AS (SELECT path, t FROM now), {PAIRS} SELECT p, least(p, q) AS a, greatest(p, q) AS b, sim FROM near))
SELECT a, b, floor(sim * 1000 + 0.5) / 1000 AS score FROM o WHERE a IN (SELECT path FROM b WHERE k % 5 > 1) AND b IN (SELECT path FROM b WHERE k % 5 > 1)
UNION ALL SELECT a, b, floor(max(sim) * 1000 + 0.5) / 1000 FROM m WHERE p IN (SELECT path FROM b WHERE k % 5 = 1) GROUP BY a, b"""
)
def incremental_update(spark, sf_dir):
    rows = tree(spark, sf_dir)
    stored = assoc.embedded(assoc.chunks(rows), letters)
    built = assoc.associations(stored)
    key = F.regexp_extract("path", "([0-9]+)", 1).cast("int")
    after = rows.filter(key % 5 != 0).withColumn("text", F.when(key % 5 == 1, F.concat(F.lit("New text of this file. "), "text")).otherwise(F.col("text")))
    changes = rows.select("path", (key % 5 == 0).alias("deleted")).filter(key % 5 <= 1)
    return assoc.updated(built, stored, after, changes, letters)[0].select(F.col("a.path").alias("a"), F.col("b.path").alias("b"), "score")


@query(
    f"WITH h AS (SELECT vec_id AS id, label AS grp, {SIM} AS sim FROM embeddings ORDER BY {SIM} DESC, vec_id LIMIT 64), c AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY sim DESC, id) > 3 AS over_ FROM h), k AS (SELECT * FROM c ORDER BY over_, sim DESC, id LIMIT 8) SELECT id, grp, floor(sim * 10000 + 0.5) / 10000 AS sim FROM k"
)
def explore(spark, sf_dir):
    return assoc.explored(vectors(spark, sf_dir), QUERY).select("id", "grp", T.rounded(F.col("sim")).alias("sim"))


@query(f"WITH {NEAR} SELECT id, other, floor(sim * 10000 + 0.5) / 10000 AS sim FROM near")
def knn_by_cells(spark, sf_dir):
    """With as many cells met as there are, cells miss nothing."""
    out = assoc.recalled(floats(spark, sf_dir), centres=16, probes=16)
    return out.select("id", "other", T.rounded(F.col("sim")).alias("sim"))


@query(
    "SELECT 'a/' || n_nationkey || '.md' AS path, n_nationkey % 4 = 1 AS deleted FROM nation WHERE n_nationkey % 4 < 3 UNION ALL SELECT 'b/' || n_nationkey || '.md', false FROM nation WHERE n_nationkey % 4 = 2 UNION ALL SELECT 'c/' || n_nationkey || '.md', n_nationkey % 2 = 0 FROM nation"
)
def git_delta(spark, sf_dir):
    k = F.col("n_nationkey").cast("string")
    named = F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("M\ta/"), k, F.lit(".md"))).when(F.col("n_nationkey") % 4 == 1, F.concat(F.lit("D\ta/"), k, F.lit(".md"))).when(F.col("n_nationkey") % 4 == 2, F.concat(F.lit("R100\ta/"), k, F.lit(".md\tb/"), k, F.lit(".md")))
    state = F.concat(F.when(F.col("n_nationkey") % 2 == 0, " D ").otherwise("?? "), F.lit('"c/'), k, F.lit('.md"'))
    again = F.when(F.col("n_nationkey") % 4 == 2, F.concat(F.lit("A\ta/"), k, F.lit(".md")))
    lines = read(spark, sf_dir, "nation").select(F.explode(F.array(named, state, again)).alias("line")).filter("line IS NOT NULL")
    return assoc.git_changes(assoc.git_lines(lines))


@query("SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 3 = 2 THEN 'new' ELSE 'old' END AS kind FROM nation WHERE n_nationkey % 3 <> 1")
def table_store(spark, sf_dir):
    """Written, appended to, and without the files of a third of the keys."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("f"), F.col("n_nationkey") % 3).alias("path"))
    folder = scratch(spark)
    store.overwritten(n.filter("id % 3 < 2").withColumn("kind", F.lit("old")), folder)
    store.appended(n.filter("id % 3 = 2").withColumn("kind", F.lit("new")), folder)
    return store.without_files(spark, folder, spark.createDataFrame([("f1",)], "path string")).select("id", "kind")


# --- lineage ------------------------------------------------------------------------------------------------


def edges(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Edges between lines of nation files and region files, all proposed, then curated by key."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("k"), F.col("n_regionkey").alias("r"), F.col("n_name").alias("name"))
    src = n.select(F.concat(F.lit("n/"), "k", F.lit(".py")).alias("path"), F.concat(F.lit("# head\ndef "), F.lower("name"), F.lit("():\n    return "), "k", F.lit("\n")).alias("text"))
    dst = n.groupBy("r").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "name"))), lambda x: F.concat(F.lit("Nation "), x["name"])), "\n").alias("text")).select(F.concat(F.lit("r/"), "r", F.lit(".md")).alias("path"), "text")
    place = F.row_number().over(Window.partitionBy("r").orderBy("k"))
    p = n.withColumn("place", place).select(
        F.concat(F.lit("n/"), "k", F.lit(".py")).alias("src_file"), F.lit(2).alias("src_start"), F.lit(3).alias("src_end"), F.concat(F.lit("r/"), "r", F.lit(".md")).alias("dst_file"), F.col("place").alias("dst_start"), F.col("place").alias("dst_end"),
        F.lower("name").alias("src_symbol"), F.lower("name").alias("dst_symbol"), F.lit("documents").alias("rel"), (F.col("k") / 100.0).alias("score"), F.when(F.col("k") % 2 == 0, "symbol").otherwise("embedding").alias("via"), F.col("k").cast("long").alias("seq"),
    )
    tree_ = src.union(dst)
    made = settled(lineage.proposed(lineage.empty(spark), p, tree_))
    again = settled(lineage.proposed(made, p.withColumn("seq", F.col("seq") + 1000), tree_))  # known pairs are not added again
    key = F.regexp_extract("src_file", "([0-9]+)", 1).cast("int")
    decisions = again.filter(key % 3 != 2).select("id", F.when(key % 3 == 0, "confirmed").otherwise("rejected").alias("status"), F.lit(None).cast("string").alias("rel"), F.lit("seen").alias("note"), F.lit("human").alias("by"))
    return settled(lineage.curated(again, decisions, tree_)), tree_


@query("SELECT CASE n_nationkey % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' ELSE 'proposed' END AS status, CASE WHEN n_nationkey % 2 = 0 THEN 'symbol' ELSE 'embedding' END AS via, count(*)::BIGINT AS n FROM nation GROUP BY ALL")
def edge_stats(spark, sf_dir):
    return lineage.stats(edges(spark, sf_dir)[0])


@query("SELECT 'n/' || n_nationkey || '.py' AS src_file, 'r/' || n_regionkey || '.md' AS dst_file, CASE n_nationkey % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' ELSE 'proposed' END AS status, n_nationkey / 100.0::DOUBLE AS score FROM nation ORDER BY n_nationkey % 3 = 2 DESC, score DESC LIMIT 10")
def edge_list(spark, sf_dir):
    return lineage.listed(edges(spark, sf_dir)[0], most=10).select("src_file", "dst_file", "status", "score")


@query("SELECT 'n/' || n_nationkey || '.py' AS file, CASE n_nationkey % 4 WHEN 0 THEN 'moved' WHEN 2 THEN 'missing' ELSE 'impact' END AS state FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey % 4 <> 1")
def edge_impact(spark, sf_dir):
    e, tree_ = edges(spark, sf_dir)
    key = F.expr("try_cast(regexp_extract(path, 'n/([0-9]+)', 1) as int)") % 4
    code_ = F.col("path").startswith("n/")
    after = tree_.filter(~code_ | F.coalesce(key != 2, F.lit(True))).withColumn("text", F.when(code_ & (key == 0), F.concat(F.lit("# new\n\n"), "text")).when(code_ & (key == 3), F.regexp_replace("text", "return", "yield")).otherwise(F.col("text")))
    return lineage.impact(e, after, tree_.filter(code_).select("path")).filter("side = 'src'").select("file", "state")


@query(
    "SELECT n_nationkey::BIGINT + 1 AS id, 'n/' || n_nationkey || '.py' AS src_file, CASE WHEN n_nationkey % 3 = 0 THEN 3 ELSE 2 END::BIGINT AS src_start, CASE WHEN n_nationkey % 3 = 0 THEN 4 ELSE 3 END::BIGINT AS src_end, CASE n_nationkey % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' ELSE 'proposed' END AS status, substr(sha1('def ' || regexp_replace(lower(n_name), ' +', ' ', 'g') || '():' || chr(10) || 'return ' || n_nationkey), 1, 16) AS src_hash FROM nation"
)
def edge_stamp(spark, sf_dir):
    e, tree_ = edges(spark, sf_dir)
    after = tree_.withColumn("text", F.when(F.col("path").startswith("n/"), F.concat(F.lit("# new\n"), "text")).otherwise(F.col("text")))
    return lineage.stamped(e, after).select(long("id"), "src_file", long("src_start"), long("src_end"), "status", "src_hash")


# --- translations, code, discovery --------------------------------------------------------------------------


def translations(spark, sf_dir, whole: bool = True) -> DataFrame:
    """Every document as a file: the k-th of each language, by doc_id, is a version of page k.  All have headings, links, images and code by their doc_id, and their text if whole."""
    d = read(spark, sf_dir, "documents")
    ranked = settled(accumulated(d.select("doc_id", "lang"), [F.col("lang"), F.col("doc_id")], at=F.lit(1)))
    first = ranked.groupBy(F.col("lang").alias("of")).agg(F.min("at").alias("first"))
    ranked = ranked.join(F.broadcast(first), F.col("lang").eqNullSafe(F.col("of"))).select("doc_id", "lang", (F.col("at") - F.col("first") + 1).alias("page"))
    ranked = ranked.join(d.select("doc_id", "text"), "doc_id") if whole else ranked.withColumn("text", F.lit(""))
    heads = F.array_join(F.array_repeat(F.lit("## Part"), (F.col("doc_id") % 3).cast("int") + 1), "\n\n")
    more = [F.when(F.col("doc_id") % k == r, F.lit(x)).otherwise("") for k, r, x in ((2, 1, "\n\n```\ncode\n```"), (5, 0, "\n\n![i](i.png)"), (7, 0, "\n\n[l](https://x.org)"))]
    return ranked.select(F.concat(F.lit("docs/page"), "page", F.when(F.col("lang") == "en", "").otherwise(F.concat(F.lit("."), "lang")), F.lit(".md")).alias("path"), F.concat(heads, *more, F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("text"))


TRANSLATIONS = "t AS (SELECT row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS page, lang, doc_id FROM documents)"


@query(f"WITH {TRANSLATIONS} SELECT 'docs/page' || a.page || '.md' AS source, 'docs/page' || a.page || '.' || b.lang || '.md' AS path, b.lang AS locale FROM t a JOIN t b ON a.page = b.page AND a.lang = 'en' AND b.lang <> 'en'")
def translation_sets(spark, sf_dir):
    out = i18n.sets(translations(spark, sf_dir, False).select("path")).filter("is_source")
    return out.select("source", F.explode("siblings").alias("s")).select("source", "s.path", "s.locale")


@query(
    f"""WITH {TRANSLATIONS}, p AS (SELECT 'docs/page' || a.page || '.md' AS source, 'docs/page' || a.page || '.' || b.lang || '.md' AS path, a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.page = b.page AND a.lang = 'en' AND b.lang <> 'en')
SELECT source, path, 'headings' AS what, x % 3 + 1 AS there, y % 3 + 1 AS here FROM p WHERE x % 3 <> y % 3 UNION ALL SELECT source, path, 'code blocks', x % 2, y % 2 FROM p WHERE x % 2 <> y % 2
UNION ALL SELECT source, path, 'images', CASE WHEN x % 5 = 0 THEN 1 ELSE 0 END, CASE WHEN y % 5 = 0 THEN 1 ELSE 0 END FROM p WHERE (x % 5 = 0) <> (y % 5 = 0) UNION ALL SELECT source, path, 'links', 1, 0 FROM p WHERE x % 7 = 0 AND y % 7 <> 0"""
)
def translation_drift(spark, sf_dir):
    out = i18n.sweep(translations(spark, sf_dir)).select("source", "path", F.explode("drift").alias("d"))
    return out.select("source", "path", "d.what", F.col("d.source").cast("long").alias("there"), F.col("d.here").cast("long").alias("here"))


def sources(spark, sf_dir) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    py = n.select(F.concat(F.lit("src/n"), "n_nationkey", F.lit(".py")).alias("path"), F.concat(F.lit("class Land"), F.col("n_nationkey") + 100, F.lit(":\n    x = 1\n\ndef _hidden():\n    pass\n\ndef visit_"), F.col("n_nationkey") + 100, F.lit("(a):\n    # the the comment\n    return a\n")).alias("text"))
    md = n.select(F.concat(F.lit("docs/n"), "n_nationkey", F.lit(".md")).alias("path"), F.concat(F.lit("# Page\n\nCall `visit_"), F.col("n_nationkey") + 100, F.lit("(a)` here.\nMore of it.\n\nOther.\n")).alias("text"))
    return py.union(md)


@query("SELECT 'src/n' || n_nationkey || '.py' AS path, name || n_nationkey + 100 AS name, kind, line::BIGINT AS line FROM nation, (VALUES ('Land', 'class', 1), ('visit_', 'function', 7)) v(name, kind, line)")
def surface_items(spark, sf_dir):
    return code.surface(sources(spark, sf_dir)).select("path", "name", "kind", long("line"))


@query("SELECT 'src/n' || n_nationkey || '.py' AS src_file, 7::BIGINT AS src_start, 9::BIGINT AS src_end, 'docs/n' || n_nationkey || '.md' AS dst_file, 3::BIGINT AS dst_start, 5::BIGINT AS dst_end, 'visit_' || n_nationkey + 100 AS src_symbol FROM nation")
def symbol_proposals(spark, sf_dir):
    return code.proposals(sources(spark, sf_dir)).select("src_file", long("src_start"), long("src_end"), "dst_file", long("dst_start"), long("dst_end"), "src_symbol")


@query(
    """WITH s AS (SELECT 'src' AS folder, 'src/n' || n_nationkey || '.py' AS path, 'class Land' || n_nationkey + 100 || ':' AS a, 'def visit_' || n_nationkey + 100 || '(a):' AS b FROM nation),
c AS (SELECT *, length(path) + 12 + length(a) + length(b) + 2 AS cost FROM s), r AS (SELECT *, row_number() OVER (ORDER BY path) AS i FROM c),
w AS (SELECT *, (i - 1) // 3 AS chunk FROM r)
SELECT folder, chunk::BIGINT AS chunk, path, (4 * ((i - 1) % 3) + 1)::BIGINT AS first, '// === ' || path || ' ===' || chr(10) || a || chr(10) || b AS text FROM w"""
)
def surface_chunks(spark, sf_dir):
    """Chunks of three files: a file takes 62 to 66 characters of 210."""
    out = code.rendered(code.surface(sources(spark, sf_dir)), 210)
    return out.select("folder", long("chunk"), "path", long("first"), "text")


@query("SELECT 'src/n' || n_nationkey || '.py' AS path, 'visit_' || n_nationkey + 100 AS name, 7::BIGINT AS line, (n_nationkey % 4) / 10.0::DOUBLE AS score FROM nation")
def surface_unexplained(spark, sf_dir):
    """Every function is named by a span of a scan, and by another of a higher score."""
    chunks = code.chunk_texts(code.rendered(code.surface(sources(spark, sf_dir)), 210))
    names = F.regexp_extract_all("text", F.lit("visit_([0-9]+)"), F.lit(1))
    flags = chunks.select("folder", "chunk", F.explode(names.cast("array<int>")).alias("n")).select("folder", "chunk", F.concat(F.lit("def   visit_"), "n", F.lit("(a)")).alias("text"), F.explode(F.array((F.col("n") - 100) % 4 / 10.0, F.lit(0.9))).alias("score"))
    return code.unexplained(chunks, flags).select("path", "name", long("line"), "score")


@query("SELECT CASE WHEN n_nationkey % 4 = 0 THEN 'docs/n' || n_nationkey || '.md' WHEN n_nationkey % 4 = 1 THEN 'x/n' || n_nationkey || '.mdx' END AS path FROM nation WHERE n_nationkey % 4 < 2")
def api_pages(spark, sf_dir):
    k = F.col("n_nationkey")
    path = F.when(k % 4 == 0, F.concat(F.lit("docs/n"), k, F.lit(".md"))).when(k % 4 == 1, F.concat(F.lit("x/n"), k, F.lit(".mdx"))).when(k % 4 == 2, F.concat(F.lit("blog/n"), k, F.lit(".md"))).otherwise(F.concat(F.lit("docs/n"), k, F.lit(".api.mdx")))
    return code.api_pages(read(spark, sf_dir, "nation").select(path.alias("path"), F.lit("x").alias("text"))).select("path")


@query("SELECT 'src/n' || n_nationkey || '.py' AS path, 'repeated-word' AS rule_id, 8::BIGINT AS line FROM nation")
def source_strings(spark, sf_dir):
    rows = code.readable(sources(spark, sf_dir))
    return detect.detected(rows, detect.Settings(only=frozenset(["repeated-word"])), "path").select("path", "rule_id", long("line"))


@query(
    "SELECT * FROM (VALUES ('api-docs', 'src/api/**'), ('schema-docs', 'db/migrations/**'), ('config-docs', 'app/config/**'), ('package-readme', 'packages/*/src/**')) v(name, path)"
)
def rule_discovery(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.concat(F.element_at(F.array(*map(F.lit, ("src/api/", "db/migrations/", "packages/a/src/", "packages/b/src/", "app/config/"))), F.col("n_nationkey") % 5 + 1), F.lower("n_name"), F.lit(".py")).alias("path"))
    return code.discovered(n).select("name", F.explode("paths").alias("path"))


@query("SELECT 'src/n' || n_nationkey || '.py' AS path, CASE WHEN n_nationkey < 10 THEN 'one' ELSE NULL END AS rule FROM nation")
def edit_rule_match(spark, sf_dir):
    rows = sources(spark, sf_dir).filter(F.col("path").endswith(".py"))
    rules = [{"name": "one", "paths": ["src/n?.py"], "notify": "look"}, {"name": "none", "paths": ["src/**"], "exclude": ["**/*.py"], "notify": "x"}]
    return rows.select("path", F.try_element_at(F.transform(edit_rules(F.col("path"), rules), lambda r: r["name"]), F.lit(1)).alias("rule"))


@query("SELECT 'docs/n' || n_nationkey || '.md' AS path FROM nation WHERE n_nationkey >= 10")
def ignored_files(spark, sf_dir):
    rows = sources(spark, sf_dir).filter(F.col("path").rlike(files.PROSE))
    return rows.filter(~matches(F.col("path"), ["**/n?.md"])).select("path")


# --- pages, events, models ----------------------------------------------------------------------------------


@query("SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages")
def html_links(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.explode(T.hrefs(F.col("html"))).alias("href"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '<h([1-6])[^>]*>', 1))::INT AS level FROM pages")
def html_headings(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.explode(T.heading_levels(F.col("html"))).alias("level"))


def edits(spark, sf_dir) -> DataFrame:
    return edit_rows(read(spark, sf_dir, "conversations"))


def edit_rows(c: DataFrame) -> DataFrame:
    """Every turn of a conversation as an edit of a page."""
    said = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("I hope this helps. "), "text")).otherwise(F.col("text"))
    body = F.struct(F.lit("Edit").alias("tool_name"), F.struct(F.concat(F.lit("docs/"), "conv_id", F.when(F.col("turn") % 2 == 0, ".md").otherwise(".py")).alias("file_path"), said.alias("new_string")).alias("tool_input"))
    return c.select("conv_id", "turn", F.to_json(body).alias("value"))


GATE = "SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 AND turn % 2 = 0 AND text IS NOT NULL THEN 'deny' ELSE 'allow' END AS decision FROM conversations"


@query(GATE)
def edit_events_gate(spark, sf_dir):
    return events.gated(edits(spark, sf_dir), detect.Settings(only=frozenset(["assistant-meta"]))).select("conv_id", "turn", "decision")


@query(GATE)
def edit_events_stream(spark, sf_dir):
    """The same, as a stream over the table's files that ends with them."""
    folder = scratch(spark)
    table = read(spark, sf_dir, "conversations")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/conversations.parquet")
    alone = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    stream = spark.readStream.schema(table.schema)
    stream = stream.option("pathGlobFilter", "conversations.parquet").parquet(sf_dir) if alone else stream.parquet(f"{sf_dir}/conversations.parquet")
    gate = events.gated(edit_rows(stream), detect.Settings(only=frozenset(["assistant-meta"]))).select("conv_id", "turn", "decision")
    out = gate.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.schema(gate.schema).parquet(f"{folder}/out")


@query(
    "WITH e AS (SELECT DISTINCT 'docs/n' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '.md' ELSE '.de.md' END AS file, n_nationkey AS k FROM nation) SELECT file, 'rule' AS kind, '[one] look' AS text FROM e WHERE k < 10 AND k % 2 = 0 UNION ALL SELECT file, 'translation', 'de docs/n' || k || '.de.md' FROM e WHERE k % 2 = 0 UNION ALL SELECT file, 'association', 'src/n' || k || '.py' FROM e WHERE k % 3 <> 0 UNION ALL SELECT file, 'lineage', 'edge #' || k || ' impact src/x.py:1' FROM e WHERE k % 3 = 0"
)
def edit_notices(spark, sf_dir):
    """What an edit of each page asks for: rules, translations, links that it breaks, and, where there are none of these, associations."""
    k = F.col("n_nationkey")
    page = F.concat(F.lit("docs/n"), k, F.lit(".md"))
    other = F.concat(F.lit("docs/n"), k, F.lit(".de.md"))
    file = F.when(k % 2 == 0, page).otherwise(other)
    n = read(spark, sf_dir, "nation").withColumn("file", file)
    events_ = n.select(F.to_json(F.struct(F.lit("Edit").alias("tool_name"), F.struct(F.col("file").alias("file_path"), F.lit("x").alias("new_string")).alias("tool_input"))).alias("value"))
    sets = i18n.sets(n.select(F.explode(F.array(page, other)).alias("path")))
    broken = n.filter(k % 3 == 0).select("file", k.alias("edge"), F.lit("impact").alias("state"), F.lit("src/x.py").alias("other_file"), F.lit(1).alias("other_start"))
    near = n.select(F.col("file").alias("path"), F.concat(F.lit("src/n"), k, F.lit(".py")).alias("other"))
    rules = [{"name": "one", "paths": ["docs/n?.md"], "notify": "look"}]
    return events.notices(events_, rules, sets, lambda changed: broken.join(changed.select(F.col("path").alias("file")).distinct(), "file", "left_semi"), near)


@query()
def edit_event_lints(spark, sf_dir):
    return events.lints(edits(spark, sf_dir)).select("conv_id", "turn", "file", "rule_id", "severity", "label")


@query("SELECT doc_id, floor(1 / (1 + exp((n_chars / 100.0::DOUBLE - 50) / 22)) * 10000 + 0.5) / 10000 AS machine FROM documents")
def machine_likelihood(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.rounded(models.machine_score(F.col("n_chars") / 100.0)).alias("machine"))


def attention(spark, sf_dir) -> DataFrame:
    """A scan for each region, whose queries are its nations and whose context has 12 parts; a cell's score follows from both."""
    n = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("scan"), F.col("n_nationkey").alias("q"))
    return n.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("score", ((F.col("q") * 7 + F.col("c") * 5) % 11 + F.when(F.col("c") % 4 == 0, 20).otherwise(1)).cast("double"))


ATTENTION = "a AS (SELECT n_regionkey AS scan, n_nationkey AS q, c, ((n_nationkey * 7 + c * 5) % 11 + CASE WHEN c % 4 = 0 THEN 20 ELSE 1 END)::DOUBLE AS score FROM nation, (SELECT unnest(range(12)) AS c))"


@query(f"WITH {ATTENTION}, s AS (SELECT scan, c, sum(score) AS s FROM a GROUP BY ALL) SELECT scan, c, floor(s / max(s) OVER (PARTITION BY scan) * 10000 + 0.5) / 10000 AS share, s / max(s) OVER (PARTITION BY scan) < 0.3 AS flagged FROM s")
def attention_coverage(spark, sf_dir):
    return models.coverage(attention(spark, sf_dir), "c", scan="scan").select("scan", long("c"), T.rounded(F.col("share")).alias("share"), "flagged")


@query(f"WITH {ATTENTION}, s AS (SELECT scan, q, sum(score) AS s FROM a GROUP BY ALL), f AS (SELECT *, s / max(s) OVER (PARTITION BY scan) AS share FROM s) SELECT scan, q, floor(share * 10000 + 0.5) / 10000 AS share FROM f WHERE share < 0.97 AND q % 2 = 0")
def attention_unanchored(spark, sf_dir):
    a = attention(spark, sf_dir)
    texts = a.select("scan", "q").distinct().withColumn("text", F.when(F.col("q") % 2 == 0, "long enough").otherwise("short"))
    return models.unanchored(a, texts, 0.97).select("scan", "q", T.rounded(F.col("share")).alias("share"))


@query(
    f"""WITH {ATTENTION}, s AS (SELECT scan, c, sum(score) AS s FROM a GROUP BY ALL), f AS (SELECT scan, c, s / max(s) OVER (PARTITION BY scan) AS share FROM s),
g AS (SELECT *, c - row_number() OVER (PARTITION BY scan ORDER BY c) AS i FROM f WHERE share >= 0.6) SELECT scan, min(c) AS first, max(c) AS last, floor(max(share) * 10000 + 0.5) / 10000 AS score FROM g GROUP BY scan, i HAVING sum(CASE WHEN c = 8 THEN 3 ELSE 12 END) >= 12"""
)
def attention_focus(spark, sf_dir):
    """Runs of context of 12 characters at least; part 8 has but 3."""
    a = attention(spark, sf_dir)
    texts = a.select("scan", "c").distinct().withColumn("text", F.when(F.col("c") == 8, "abc").otherwise("abcdefghijkl"))
    return models.focused(a, texts).select("scan", long("first"), long("last"), T.rounded(F.col("score")).alias("score"))


@query(
    f"""WITH {ATTENTION}, l AS (SELECT scan, q, c, score * (k.layer + 1) / (h.head + 1) / 100 AS weight FROM a, (VALUES (5), (6), (7), (8)) k(layer), (VALUES (0), (1)) h(head) WHERE k.layer BETWEEN 6 AND 8),
m AS (SELECT scan, q, c, sum(weight) / 6 AS weight FROM l GROUP BY ALL), g AS (SELECT scan, q % 4 AS chunk, c // 3 AS t, sum(weight) / count(DISTINCT q) AS s FROM m GROUP BY ALL)
SELECT scan, chunk::BIGINT AS q, t::BIGINT AS c, floor(s / sum(s) OVER (PARTITION BY scan, chunk) * 10000 + 0.5) / 10000 AS score FROM g"""
)
def attention_scan(spark, sf_dir):
    """Layers 6 to 8 of 10, two heads; queries in chunks by key modulo four, context in chunks of three."""
    a = attention(spark, sf_dir).withColumnRenamed("score", "s")
    captured = a.withColumns({"layer": F.explode(F.sequence(F.lit(5), F.lit(9)))}).withColumn("head", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("weight", F.col("s") * (F.col("layer") + 1) / (F.col("head") + 1) / 100).select("scan", "layer", "head", "q", "c", "weight")
    queries_ = a.select("scan", "q").distinct().withColumn("chunk", F.col("q") % 4)
    context = a.select("scan", "c").distinct().withColumn("to", F.floor(F.col("c") / 3))
    return models.scanned(captured, 10, queries_, context, sinks=False, normalized=False).select("scan", long("q"), long("c"), T.rounded(F.col("score")).alias("score"))


@query(
    f"""WITH {ATTENTION}, m AS (SELECT scan, c, list_sort(list(w))[len(list(w)) // 2 + 1] AS med FROM (SELECT scan, c, CASE WHEN c = 4 THEN score * 1e9 ELSE score END AS w FROM a) GROUP BY ALL),
g AS (SELECT scan, c, ln(med + 0.5e-12 + 1e-12) AS x FROM m), k AS (SELECT scan, avg(x) + 3 * stddev_pop(x) AS line FROM g GROUP BY scan) SELECT scan, count(*) FILTER (WHERE x > line)::BIGINT AS sinks FROM g JOIN k USING (scan) GROUP BY scan"""
)
def attention_sinks(spark, sf_dir):
    a = attention(spark, sf_dir)
    matrix = a.select("scan", F.lit(0).alias("chunk"), "q", "c", F.when(F.col("c") == 4, F.col("score") * 1e9).otherwise(F.col("score")).alias("weight"))
    out = models.without_sinks(matrix).groupBy("scan", "c").agg(F.max("weight").alias("w"))
    return out.groupBy("scan").agg(F.sum((F.col("w") == 0).cast("long")).alias("sinks"))


@query(f"WITH {ATTENTION} SELECT scan, count(*)::BIGINT AS cells, count(DISTINCT q)::BIGINT AS queries FROM a GROUP BY scan")
def attention_archives(spark, sf_dir):
    """What the archives hold, read back."""
    a = attention(spark, sf_dir)
    side = lambda c: a.select("scan", c).distinct().withColumn("text", F.concat(F.lit(c), c))
    out = heatmap.archives(a, side("q"), side("c"))

    @F.udf("struct<cells:bigint,queries:bigint>")
    def counts(archive):
        held = heatmap.unpacked(bytes(archive))
        return len(held["cells"]), len(held["queries"])

    return out.select("scan", counts("archive").alias("x")).select("scan", "x.*")


@query("SELECT doc_id, substr(sha1(text), 1, 16) AS hash FROM documents")
def text_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.text_hash(F.col("text")).alias("hash"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detector with all rules over all documents, and every document's score."""
    return score.detected_scores(read(ship(spark), sf_dir, "documents"))


@query("SELECT n_nationkey::BIGINT AS id, (length(n_name) + 2 + 1)::BIGINT AS units, 'a' || chr(10) || chr(10) || n_name || chr(10) AS even, 'x = 1' || chr(10) || chr(10) || 'y' || chr(10) AS bare, sha256('m' || chr(31) || n_name) AS key FROM nation")
def text_modes(spark, sf_dir):
    """Offsets in UTF-16, even white space, Python without comments, and keys of kept results."""
    n = F.col("n_name")
    spaced = F.concat(F.lit("  a  \n\n\n\n"), n, F.lit("\n\n"))
    py = F.lit("x = 1 # one\n\'\'\'doc\nof it\'\'\'\n# all\ny\n")
    return read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("id"), T.utf16(F.concat(F.lit("\U0001f680"), n, F.lit("bc")), F.length(n) + 2).cast("long").alias("units"), T.stripped(spaced, "whitespace").alias("even"), T.stripped(py, "python").alias("bare"), T.cache_key(F.lit("m"), n).alias("key")
    )


@query(
    "SELECT n_nationkey::BIGINT AS doc_id, v.n::BIGINT AS n, v.tighter, v.flags FROM nation, (VALUES (1, 'They went to swim.', 'wordy-phrase'), (2, NULL, ''), (3, 'So they use it.', 'complex-word,ms-wordiness')) v(n, tighter, flags)"
)
def sentence_variants(spark, sf_dir):
    docs = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.lit("They went in order to swim. The boat sank.  So they utilize   it.").alias("text"))
    only = detect.Settings(only=frozenset(["wordy-phrase", "complex-word", "ms-wordiness"]))
    return models.variants(docs, only).select("doc_id", long("n"), "tighter", F.array_join("flags", ",").alias("flags"))


@query("SELECT n_nationkey::BIGINT AS doc_id, 'grammar-agreement' AS rule_id, 2::BIGINT AS line, 3::BIGINT AS col, 'goes' AS span, 'Number. Suggested: \"go\" / (remove).' AS message FROM nation")
def grammar_slot(spark, sf_dir):
    """A checker that finds every "goes" and a kind that is not kept."""

    def check(texts: list[str]) -> list[list[dict]]:
        lint = lambda t, kind: {"kind": kind, "rule": "R", "start": t.index("goes"), "end": t.index("goes") + 4, "message": "Number.", "suggestions": ["go", ""]}
        return [[lint(t, "Agreement"), lint(t, "Spelling")] for t in texts]

    docs = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.concat("n_name", F.lit("\na goes b")).alias("text"))
    return models.grammar(docs, check).select("doc_id", "rule_id", long("line"), long("col"), "span", "message")


@query("SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 2 = 0 THEN 14 END::BIGINT AS a, CASE WHEN n_nationkey % 2 = 0 THEN 21 END::BIGINT AS b, NULL::BIGINT AS c FROM nation WHERE n_nationkey % 2 = 0")
def edge_refinement(spark, sf_dir):
    """Spans of 31 lines narrowed to the three best of four regions; those of 5 lines stay."""
    n = read(spark, sf_dir, "nation")
    edges_ = n.select(F.col("n_nationkey").alias("id"), F.lit(10).alias("src_start"), F.when(F.col("n_nationkey") % 2 == 0, 40).otherwise(15).alias("src_end"), F.lit(1).alias("dst_start"), F.lit(4).alias("dst_end"))
    found = [("src", 15, 16, 0.9), ("src", 17, 18, 0.8), ("src", 20, 20, 0.7), ("src", 38, 39, 0.1), ("dst", 2, 2, 0.9)]
    spans = n.crossJoin(F.broadcast(spark.createDataFrame(found, "side string, first int, last int, score double"))).select(F.col("n_nationkey").alias("id"), "side", "first", "last", "score")
    return models.narrowed(edges_, spans).select(long("id"), F.col("src_start").cast("long").alias("a"), F.col("src_end").cast("long").alias("b"), F.col("dst_start").cast("long").alias("c"))


@query("SELECT via, count(*)::BIGINT AS n FROM (SELECT 'symbol' AS via FROM nation UNION ALL SELECT 'embedding' FROM nation WHERE n_nationkey % 2 = 0) GROUP BY via")
def all_proposals(spark, sf_dir):
    n = read(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0")
    end = lambda f: F.struct(F.concat(F.lit(f), "n_nationkey").alias("path"), F.lit("L1").alias("chunk"), F.lit(1).alias("start"), F.lit(2).alias("end"))
    rows = n.select(end("a").alias("a"), end("b").alias("b"), F.lit(0.5).alias("score"), F.lit("embedding").alias("via"))
    return lineage.all_proposals(code.proposals(sources(spark, sf_dir)), rows).groupBy("via").agg(F.count("*").alias("n"))


from quillgrid.plans import trees  # noqa: E402, F401 - registers its queries
