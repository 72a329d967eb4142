"""Queries over the generated tables, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid import ship
from quillgrid.llm import bpe, embdedup, fmquality, hostrules, htmltext, linededup, minhash, mix, pii, sharding

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in turn, share of all words that the mix holds, and uses of a document.
WEIGHTS, SHARE, MOST = [3.0, 1.0, 2.0], 1.5, 2
#: Score from which a document is of good quality.
PASS = 0.3
SHARDS = [f"shard-{k:03d}" for k in range(100)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, pieces = mix.mixed(read(spark, sf_dir, "documents"), WEIGHTS, SHARE, MOST)
    return mix.taken(documents, pieces).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduplicated(read(spark, sf_dir, "documents"), passage=linededup.PASSAGE).select("doc_id", "text", "removed")


def op2_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By windows of three lines alone."""
    return linededup.deduplicated(read(spark, sf_dir, "documents")).select("doc_id", "text", "removed")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(read(spark, sf_dir, "documents"), SHARDS)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encode, _, digest = bpe.udfs(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", digest(encode(F.coalesce("text", F.lit("")))).alias("d")).select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embdedup.near_duplicates(read(spark, sf_dir, "embeddings"), 0.98)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(read(spark, sf_dir, "documents"), 85)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hostrules.judged(read(spark, sf_dir, "documents"), F.col("source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = htmltext.extracted(read(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.found(read(spark, sf_dir, "documents"))
    rank = F.create_map(*[F.lit(x) for k, kind in enumerate(pii.KINDS) for x in (kind, k)])
    order = lambda spans: F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))))
    said = lambda spans: F.array_join(F.transform(order(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.filter(F.col("base.kind"), lambda k: k == kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.concat("base", "added")).alias("spans"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    score = fmquality.scored(docs, fmquality.learned(docs, read(spark, sf_dir, "labels")))
    out = docs.select("doc_id", fmquality.held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= PASS).cast("int"))


def op1_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each source (by its place), beside what it should."""
    documents, pieces = mix.mixed(read(spark, sf_dir, "documents"), WEIGHTS, SHARE, MOST)
    out = mix.taken(documents, pieces).groupBy("place", "source_size", "target").agg(F.sum("taken").alias("taken"), F.max(F.col("taken") - MOST * F.col("size")).alias("over"))
    return out.select("place", "source_size", (F.floor(F.col("target") * 1000 + 0.5) / 1000).alias("target"), "taken", (F.col("over") > 0).alias("over"))


def op8_known_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of five sites made of the parts, without any element or name that says what is text: lines of the site around and between two of the page."""
    k, site = F.col("p_partkey"), F.concat(F.lit("site "), F.col("p_partkey") % 5)
    line = lambda *x: F.concat(F.lit("<div><span>"), *[F.lit(y) if isinstance(y, str) else y for y in x], F.lit("</span></div>\n"))
    html = F.concat(F.lit("<html><body>"), line("Start of ", site), line("Part ", k, " is a ", F.col("p_name")), line("Ask ", site, " &amp; others"), line("It is of type ", F.col("p_type"), ", number ", k), line("Terms of ", site), F.lit("</body></html>"))
    pages = read(spark, sf_dir, "part").select(k.alias("page_id"), F.concat(F.lit("https://www.site"), k % 5, F.lit(".org/parts/"), k).alias("url"), html.alias("html"))
    return htmltext.extracted(pages).select("page_id", "text")


def op9_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_pii(spark, sf_dir).select("doc_id", *[f"n_{kind}" for kind in pii.KINDS])


QUERIES = {
    f.__name__: f
    for f in (op1_mix, op2_line_dedup, op3_sharding, op4_bpe, op5_embedding_dedup, op6_minhash, op7_host_rules, op8_html, op9_pii, op10_quality, op1_sources, op2_window_dedup, op8_known_pages, op9_counts)
}
#: Lines with a word, numbered, and what is left of texts without the lines c.
LINES = r"""
WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
w AS (SELECT *, rtrim(line, ' ' || chr(9) || chr(13)) AS k, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),"""
REMOVED = r"""
g AS (SELECT w.doc_id, w.i FROM w JOIN c USING (doc_id, p))
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce((SELECT string_agg(l.line, chr(10) ORDER BY l.i) FROM l ANTI JOIN g USING (doc_id, i) WHERE l.doc_id = d.doc_id), '') END AS text, (SELECT count(*) FROM g WHERE g.doc_id = d.doc_id)::BIGINT AS removed FROM documents d"""
ORACLE_SQL: dict[str, str] = {
    "op1_sources": r"""
WITH d AS (SELECT source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents), s AS (SELECT source, sum(n)::BIGINT AS size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s), v AS (SELECT *, [3.0, 1.0, 2.0][(place % 3 + 1)::INT]::DOUBLE AS w, 2 * size AS cap FROM w),
l AS (SELECT cap / w AS reach, (1.5 * (SELECT sum(size) FROM v) - coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM v),
t AS (SELECT place, size, least(cap, w * coalesce((SELECT max(level) FROM l WHERE level <= reach), 1e300)) AS target FROM v)
SELECT place::BIGINT AS place, size AS source_size, floor(target * 1000 + 0.5) / 1000 AS target, floor(target + 1e-6)::BIGINT AS taken, false AS over FROM t""",
    "op8_known_pages": "SELECT p_partkey AS page_id, 'Part ' || p_partkey || ' is a ' || p_name || chr(10) || 'It is of type ' || p_type || ', number ' || p_partkey AS text FROM part",
    "op9_counts": r"""
WITH m AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS e, regexp_extract_all(coalesce(text, ''), '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') AS i,
 list_transform(regexp_extract_all(coalesce(text, ''), '[0-9](?:[\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS c, regexp_extract_all(coalesce(text, ''), '\+[0-9][\x20().0-9-]+[0-9]') AS p FROM documents)
SELECT doc_id, len(e)::BIGINT AS n_email, len(list_filter(i, lambda x: list_max(list_transform(string_split(x, '.'), lambda y: y::HUGEINT)) <= 255))::BIGINT AS n_ip,
 len(list_filter(c, lambda x: length(x) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length(x)), lambda k: CASE WHEN k % 2 = 0 THEN substr(reverse(x), k + 1, 1)::INT ELSE 2 * substr(reverse(x), k + 1, 1)::INT - CASE WHEN substr(reverse(x), k + 1, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0))::BIGINT AS n_card,
 len(list_filter(p, lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15))::BIGINT AS n_phone FROM m""",
    # the table of slots is filled by turns, which SQL cannot say; tests fill it in another way
    "op3_sharding": f"""
SELECT doc_id, s AS slot, 'shard-' || lpad(o[s + 1]::VARCHAR, 3, '0') AS shard FROM (SELECT doc_id, ('0x' || substr(md5(CASE WHEN doc_id IS NULL THEN 't' || coalesce(text, '') ELSE 'k' || doc_id END), 1, 15))::BIGINT % 65537 AS s FROM documents), (SELECT {sharding.lookup(SHARDS, 65_537).tolist()} AS o)""",
    "op2_line_dedup": LINES + r"""
x AS (SELECT doc_id, p, k, n, lead(k) OVER d AS k2, lead(n) OVER d AS n2, lead(k, 2) OVER d AS k3, count(*) OVER (PARTITION BY doc_id) AS m FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
t AS (SELECT doc_id, p, 3 AS size, k, k2, k3 FROM x WHERE k3 IS NOT NULL UNION ALL SELECT doc_id, p, 1, k, NULL, NULL FROM x WHERE n > 50 OR m = 1 UNION ALL SELECT doc_id, p, 2, k, k2, NULL FROM x WHERE k2 IS NOT NULL AND (m = 2 OR greatest(n, n2) <= 50 AND n + n2 > 50)),
r AS (SELECT doc_id, p, size FROM t QUALIFY row_number() OVER (PARTITION BY size, k, k2, k3 ORDER BY doc_id, p) > 1),
c AS (SELECT DISTINCT doc_id, p + o AS p FROM r, (VALUES (0), (1), (2)) v(o) WHERE o < size),"""
    + REMOVED,
    "op2_window_dedup": LINES + r"""
t AS (SELECT doc_id, p, k, lead(k) OVER d AS k2, lead(k, 2) OVER d AS k3 FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT doc_id, p FROM t WHERE k3 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k, k2, k3 ORDER BY doc_id, p) > 1),
c AS (SELECT DISTINCT doc_id, p + o AS p FROM r, (VALUES (0), (1), (2)) v(o)),"""
    + REMOVED,
    "op5_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
e AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT e.v, r.root FROM r JOIN e ON r.node = e.u),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT vec_id, (SELECT count(*) FROM e WHERE e.u = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.node = vec_id""",
    "op6_minhash": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) END AS sh FROM d),
x AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * n >= 85 * (len(sa.sh) + len(sb.sh) - n)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM s UNION SELECT e.v, r.root FROM r JOIN e ON r.node = e.u),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON c.node = doc_id""",
    "op7_host_rules": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
t AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM t, (VALUES (0), (1), (2), (3), (4)) v(o) GROUP BY doc_id),
f AS (SELECT d.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(CASE WHEN base_failed THEN 1 ELSE 0 END)::DOUBLE AS failed FROM b GROUP BY source),
m AS (SELECT sum(failed) / sum(n) AS mean, sum(failed * failed / n) / sum(n) AS square, count(*) / sum(1 / n) AS typical FROM h),
q AS (SELECT mean, mean * (1 - mean) AS noise, square - mean * mean - mean * (1 - mean) / greatest(typical, 1) AS spread FROM m),
k AS (SELECT source, CASE WHEN spread <= 0 THEN mean ELSE (failed + mean * greatest(noise / spread - 1, 0)) / (n + greatest(noise / spread - 1, 0)) END AS rate FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.6 AS kept FROM b JOIN k ON b.source IS NOT DISTINCT FROM k.source""",
}
