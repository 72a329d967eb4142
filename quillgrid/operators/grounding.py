"""Fact checking without models: numbers and dates of a document's claims against a table of facts.

Claims and facts are reduced to tokens, entities and typed spans by one Arrow function each; which fact fits a
claim best is a relational question.  Tokens and entities are exploded and joined by equality, so only claims
and facts that share something ever meet; the score is a sum and the best fact a max_by.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid import ship
from quillgrid.functions.dialect import compiled
from quillgrid.functions.segment import BLANKS, Document
from quillgrid.plans.session import accumulated, settled, spread

# Words that carry no content, months, and when a fact is relevant.
STOP = frozenset(
    "a an the and or but of to in on at by for with from as is are was were be been being it its this that these those there their they them we our us you your he she his her i me my has have had do does did will would can could should may might must not no yes if then than so such into over under about after before between during through up down out off only just also more most some any all each every other another which who whom whose what when where why how".split()
)
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
MONTH = {m: k for k, m in enumerate(MONTHS.split("|"), 1)}
LEAST_SCORE, LEAST_SHARED, ENTITY_WEIGHT, SPAN = 3, 1, 2, 70
#: Facts that hold a term before it counts as frequent, and the sign before entities among terms.
OFTEN, ENTITY = 200, "@"
MAGNITUDE = {"thousand": 1e3, "k": 1e3, "million": 1e6, "m": 1e6, "billion": 1e9, "b": 1e9}

TOKEN = compiled(r"[a-z][a-z'-]{2,}")
NAMES = compiled(r"\b([A-Z][A-Za-z0-9]+(?:\s+(?:[A-Z][A-Za-z0-9]+|of|the|and))*)\b")
CAPITALS = compiled(r"\b[A-Z]{2,6}\b")
PERCENT = compiled(r"(\d+(?:\.\d+)?)\s?%")
MONEY = compiled(r"\$\s?(\d[\d,]*(?:\.\d+)?)\s?(million|billion|thousand|k|m|b)?", "i")
ISO = compiled(r"\b(\d{4})-(\d{2})-(\d{2})\b")
DAY_MONTH = compiled(rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({MONTHS})\s*,?\s*(\d{{4}})\b", "i")
MONTH_DAY = compiled(rf"\b({MONTHS})\s+(\d{{1,2}})(?:st|nd|rd|th)?\s*,?\s*(\d{{4}})\b|\b({MONTHS})\s+(\d{{4}})\b", "i")
YEAR = compiled(r"\b(19|20)\d{2}\b")
COUNT = compiled(r"\b\d[\d,]*(?:\.\d+)?\b")
SOURCE = compiled(r"\s*[(\[]([^)\]]*(?:https?:\/\/|source:|\d{4})[^)\]]*)[)\]]\s*$", "i")


def tokens(text: str) -> list[str]:
    return [w for w in TOKEN.findall(text.lower()) if w not in STOP]


def entities(text: str) -> list[str]:
    """Names and acronyms in lower case; a lone capitalised word at a sentence's start is none."""
    out: dict[str, None] = {}
    for m in NAMES.finditer(text):
        name = m[1].strip(BLANKS)
        if not re.search(rf"[{BLANKS}0-9]", name) and not re.fullmatch("[A-Z]{2,}", name):
            before = text[: m.start()]
            bare = before.rstrip(BLANKS)
            if not bare or bare[-1] in ".!?:;" or "\n" in before[len(bare) :]:
                continue
        if len(name) > 2:
            out[name.lower()] = None
    out.update((m.lower(), None) for m in CAPITALS.findall(text))
    return list(out)


def plain(x: float) -> str:
    """A number as it compares: whole ones without a point."""
    return str(int(x)) if x == int(x) else repr(x)


def spans(text: str) -> list[tuple[str, str, str, int, int]]:
    """(kind, value, raw, start, end) of percentages, money, dates, years and counts; later kinds leave out what earlier ones cover."""
    if not re.search("[0-9]", text):
        return []
    out: list[tuple[str, str, str, int, int]] = []
    put = lambda kind, value, m: out.append((kind, value, m[0], m.start(), m.end()))
    free = lambda m: not any(m.start() < e and m.end() > s for *_, s, e in out)
    for m in PERCENT.finditer(text):
        put("percent", plain(float(m[1])), m)
    for m in MONEY.finditer(text):
        put("money", plain(float(m[1].replace(",", "")) * MAGNITUDE.get((m[2] or "").lower(), 1)), m)
    for m in ISO.finditer(text):
        put("date", f"{m[1]}-{int(m[2]):02d}-{int(m[3]):02d}", m)
    for m in DAY_MONTH.finditer(text):
        if free(m):
            put("date", f"{m[3]}-{MONTH[m[2].lower()]:02d}-{int(m[1]):02d}", m)
    for m in MONTH_DAY.finditer(text):
        if free(m):
            put("date", f"{m[3]}-{MONTH[m[1].lower()]:02d}-{int(m[2]):02d}" if m[1] else f"{m[5]}-{MONTH[m[4].lower()]:02d}", m)
    for m in YEAR.finditer(text):
        if free(m):
            put("year", m[0], m)
    for m in COUNT.finditer(text):
        if free(m):
            put("count", plain(float(m[0].replace(",", ""))), m)
    return out


def agree(kind: str, a: str, b: str) -> bool:
    """Dates agree also if one is the other cut off."""
    return a == b or kind == "date" and (a.startswith(b + "-") or b.startswith(a + "-"))


def mismatch(claim: list, fact: list):
    """The first kind of the claim that the fact has too, with no value in common: (kind, raw of claim, raw of fact)."""
    for kind in dict.fromkeys(s["kind"] for s in claim):
        a, b = [s for s in claim if s["kind"] == kind], [s for s in fact if s["kind"] == kind]
        if b and not any(agree(kind, x["value"], y["value"]) for x in a for y in b):
            return kind, a[0]["raw"], b[0]["raw"]
    return None


SPAN_TYPE = pa.struct([("kind", pa.string()), ("value", pa.string()), ("raw", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
PARSED = "struct<tokens:array<string>,entities:array<string>,spans:array<struct<kind:string,value:string,raw:string,start:int,end:int>>>"
CLAIM = "array<struct<start:int,line:int,col:int,text:string>>"


def parsed(texts: pa.Array) -> pa.Array:
    rows = [t or "" for t in texts.to_pylist()]
    names = SPAN_TYPE.names
    return pa.StructArray.from_arrays(
        [
            pa.array([tokens(t) for t in rows], pa.list_(pa.string())),
            pa.array([entities(t) for t in rows], pa.list_(pa.string())),
            pa.array([[dict(zip(names, s, strict=True)) for s in spans(t)] for t in rows], pa.list_(SPAN_TYPE)),
        ],
        names=["tokens", "entities", "spans"],
    )


def sentences(texts: pa.Array) -> pa.Array:
    kind = pa.struct([("start", pa.int32()), ("line", pa.int32()), ("col", pa.int32()), ("text", pa.string())])
    out = []
    for t in texts.to_pylist():
        doc = Document(t or "")
        out.append([{"start": s.start, "line": doc.place(s.start)[0], "col": doc.place(s.start)[1], "text": s.text.strip(BLANKS)} for s in doc.sentences])
    return pa.array(out, pa.list_(kind))


def claims(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n (of the sentence), start, line, col, text, tokens, entities, spans of every sentence."""
    ship(docs.sparkSession)
    cut, read = F.arrow_udf(sentences, CLAIM), F.arrow_udf(parsed, PARSED)
    rows = spread(docs.select(key, text)).select(key, F.posexplode(cut(F.coalesce(text, F.lit("")))).alias("n", "s")).select(key, "n", "s.*")
    return rows.withColumn("p", read("text")).select(key, "n", "start", "line", "col", "text", "p.*")


def checkable() -> F.Column:
    return (F.size("spans") > 0) & ((F.size("tokens") >= 2) | (F.size("entities") >= 1))


def facts(rows: DataFrame) -> DataFrame:
    """fact (its order), text, source with tokens, entities and spans."""
    ship(rows.sparkSession)
    read = F.arrow_udf(parsed, PARSED)
    return rows.withColumn("p", read("text")).select("fact", F.col("text").alias("fact_text"), "source", F.array_distinct("p.tokens").alias("fact_tokens"), F.array_distinct("p.entities").alias("fact_entities"), F.col("p.spans").alias("fact_spans"))


def read_facts(text: str) -> list[tuple[int, str, str | None]]:
    """(line, fact, source) of a fact list: one on a line, headings and comments left out, a source in brackets at the end."""
    out = []
    for k, line in enumerate(text.split("\n"), 1):
        line = line.strip(BLANKS)
        if not line or line.startswith(("#", "<!--")):
            continue
        line = compiled(r"^\d+[.)]\s+").sub("", compiled(r"^[-*+]\s+").sub("", line))
        m = SOURCE.search(line)
        source, line = (m[1], line[: m.start()].strip(BLANKS)) if m else (None, line)
        if line:
            out.append((k, line, source))
    return out


def facts_of_document(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """fact, text, source of the sentences of documents, which may be facts to hold others to; fact counts in the order of key and place."""
    rows = claims(docs, key, text).filter("text <> ''").select(key, "n", "text")
    return accumulated(rows, [F.col(key), F.col("n")], fact=F.lit(1).cast("long")).select("fact", "text", F.lit(None).cast("string").alias("source"))


def with_fact(table: DataFrame, text: str, source: str | None = None) -> DataFrame:
    """table (fact, text, source) and one more fact at its end, unless it is there."""
    line = " ".join(text.split())
    last = table.agg(F.max("fact"), F.max((F.col("text") == line).cast("int"))).first()
    if not line or last[1]:
        return table
    new = table.sparkSession.createDataFrame([((last[0] or 0) + 1, line, source)], "fact long, text string, source string")
    return table.unionByName(new)


def best(rows: DataFrame, table: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n, fact, score, shared of the claims that share a token or an entity with a fact: the fact of the highest score, the first of equals; pairs below LEAST_SCORE are left out.

    Facts that share a term that few facts hold are found by it.  Others share frequent terms only, of a weight of LEAST_SCORE in all: two
    of them, or one that the claim says three times; they are found by pairs of terms, which far fewer facts hold than any one.  Facts of
    one set of frequent terms score alike for a claim that shares nothing else with them, so there the first stands for all."""
    term = lambda e: F.concat(F.lit(ENTITY), e)
    f = table.select("fact", F.explode(F.concat("fact_tokens", F.transform("fact_entities", term))).alias("term"))
    c = rows.select(key, "n", F.explode(F.concat("tokens", F.transform("entities", term))).alias("term")).groupBy(key, "n", "term").agg(F.count("*").alias("times"))
    often = settled(f.groupBy("term").count().filter(F.col("count") > OFTEN).select("term"))
    rare = c.join(f.join(often, "term", "left_anti"), "term").select(key, "n", "fact")
    sets = f.join(often, "term").groupBy("fact").agg(F.sort_array(F.collect_set("term")).alias("terms")).groupBy("terms").agg(F.min("fact").alias("fact"))
    held = c.join(often, "term").groupBy(key, "n").agg(F.sort_array(F.collect_list("term")).alias("terms"), F.collect_list(F.when(F.col("times") >= LEAST_SCORE, F.col("term"))).alias("loud"))
    pairs = F.flatten(F.transform("terms", lambda t, k: F.transform(F.slice("terms", k + 2, F.size("terms")), lambda u: F.xxhash64(t, u))))
    ones = lambda terms: F.transform(terms, lambda t: F.xxhash64(t))
    common = held.select(key, "n", F.explode(F.concat(pairs, ones("loud"))).alias("k")).join(sets.select("fact", F.explode(F.concat(pairs, ones("terms"))).alias("k")), "k").select(key, "n", "fact")
    met = rare.union(common).distinct().join(rows.select(key, "n", "tokens", "entities"), [key, "n"]).join(table.select("fact", "fact_tokens", "fact_entities"), "fact")
    count = lambda mine, theirs: F.size(F.filter(mine, lambda x: F.array_contains(F.col(theirs), x)))
    met = met.select(key, "n", "fact", count("tokens", "fact_tokens").alias("shared"), count("entities", "fact_entities").alias("names"))
    scores = met.withColumn("score", F.col("shared") + ENTITY_WEIGHT * F.col("names")).filter(F.col("score") >= LEAST_SCORE)
    top = F.max_by(F.struct("fact", "score", "shared"), F.struct("score", -F.col("fact")))
    return scores.groupBy(key, "n").agg(top.alias("b")).select(key, "n", "b.*")


def in_report_order(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Findings of facts as they are reported: errors first, then by line and order of claims."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    return findings.orderBy(key, rank, "line", "seq")


def checked(docs: DataFrame, fact_rows: DataFrame, from_source: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Findings: claims that contradict their fact, and claims without one.  fact_rows: fact, text, source."""
    table = settled(facts(fact_rows))
    rows = settled(claims(docs, key, text).filter(checkable()))
    fit = best(rows, table, key).filter((F.col("score") >= LEAST_SCORE) & (F.col("shared") >= LEAST_SHARED))
    fit = fit.join(table.select("fact", "fact_text", "source", "fact_spans"), "fact")
    compare = F.arrow_udf(_compared, "struct<kind:string,claim:string,fact:string>")
    all_ = rows.join(fit, [key, "n"], "left")
    told = all_.withColumn("m", F.when(F.col("fact").isNotNull(), compare("spans", F.coalesce("fact_spans", F.array().cast("array<struct<kind:string,value:string,raw:string,start:int,end:int>>")))))
    valued = F.coalesce(F.get(F.filter("spans", lambda s: s["kind"].isin("money", "percent", "year", "date")), F.lit(0)), F.get("spans", F.lit(0)))["raw"]
    wrong = F.col("m.kind").isNotNull()
    rule = F.when(wrong, F.when(F.col("m.kind").isin("date", "year"), "number-date-mismatch").otherwise("contradicts-fact")).when(F.col("fact").isNull(), "unsupported-claim")
    severity = F.when(wrong, "error").otherwise("warn" if from_source else "advisory")
    message = F.when(wrong, F.concat(F.lit('Says "'), "m.claim", F.lit('", the fact "'), "m.fact", F.lit('": '), "fact_text")).otherwise(F.concat(F.lit('No fact supports "'), valued, F.lit('"')))
    span = F.trim(F.regexp_replace(F.substring("text", 1, SPAN), r"\s+", " "))
    out = told.select(key, rule.alias("rule_id"), F.lit("grounding").alias("family"), severity.alias("severity"), "line", "col", F.col("start").alias("offset"), F.least(F.length("text"), F.lit(SPAN)).alias("length"), span.alias("span"), message.alias("message"), F.col("n").alias("seq"))
    return out.filter("rule_id IS NOT NULL")


def _compared(a: pa.Array, b: pa.Array) -> pa.Array:
    rows = [mismatch(x or [], y or []) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
    return pa.array([{"kind": r[0], "claim": r[1], "fact": r[2]} if r else {"kind": None, "claim": None, "fact": None} for r in rows], pa.struct([("kind", pa.string()), ("claim", pa.string()), ("fact", pa.string())]))
