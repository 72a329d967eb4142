"""Slop score of documents, 0 to 100: density of weighted findings less signs of a person writing."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid import ship
from quillgrid.functions.text import CONTRACTION, FIRST_PERSON, WORD, n_contractions, n_first_person, n_words, rounded
from quillgrid.operators.detect import Settings, detector
from quillgrid.plans.session import spread

# Weights of severities and families, and the bands.
SEVERITY = {"error": 3.0, "warn": 2.0, "advisory": 1.0}
FAMILY = {"ai-slop": 1.0, "grounding": 1.0, "inclusive": 0.5, "clarity": 0.4, "style": 0.3}
OTHER_FAMILY, SCALE, MOST_DISCOUNT, PER_SIGNAL = 0.3, 35.0, 15.0, 1.5
BANDS = ((60, "heavy"), (30, "moderate"), (12, "light"))


def weight(severity: Column, family: Column) -> Column:
    pick = lambda column, table, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), column), F.lit(other))
    return pick(severity, SEVERITY, 1.0) * pick(family, FAMILY, OTHER_FAMILY)


def points(weighted: Column, words: Column, signals: Column, machine: Column | None = None) -> dict[str, Column]:
    """score, band and what they are made of."""
    n = F.greatest(words, F.lit(1))
    density = weighted / n * 1000
    discount = F.least(F.lit(MOST_DISCOUNT), signals / n * 1000 * PER_SIGNAL)
    plain = F.greatest(F.lit(0.0), 100 * (1 - F.exp(-density / SCALE)) - discount)
    blended = plain if machine is None else F.when(machine.isNull(), plain).otherwise(0.8 * plain + 20 * machine)
    score = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), blended)) + 0.5).cast("long")
    band = F.lit("clean")
    for least, name in reversed(BANDS):
        band = F.when(score >= least, name).otherwise(band)
    return {"density": rounded(density), "discount": rounded(discount), "score": score, "band": band}


def scored(docs: DataFrame, findings: DataFrame, key: str = "doc_id", text: Column | str = "text", machine: str | None = None) -> DataFrame:
    """A row for each of docs, those without findings too.  Findings are summed per document before the join."""
    per = findings.groupBy(key).agg(F.count("*").alias("findings"), F.sum(weight(F.col("severity"), F.col("family"))).alias("weighted"))
    if isinstance(text, str):
        docs, text = spread(docs.select(key, text, *([machine] if machine else []))), F.col(text)
    measured = docs.select(key, n_words(text).alias("words"), n_contractions(text).alias("contractions"), n_first_person(text).alias("first_person"), *([machine] if machine else []))
    # sorted on both sides: sizes that Spark guesses behind the detector are far too small for a broadcast
    out = measured.join(per.hint("merge"), key, "left").withColumns({"findings": F.coalesce("findings", F.lit(0)), "weighted": F.coalesce("weighted", F.lit(0.0))})
    out = out.withColumns(points(F.col("weighted"), F.col("words"), F.col("contractions") + F.col("first_person"), F.col(machine) if machine else None))
    return out.select(key, "words", "findings", "contractions", "first_person", "density", "discount", "score", "band")


def listed_scores(listed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """score, band and what they are made of for rows with key, text and found (detect.listed), which stays.  Nothing is shuffled."""
    t = F.col(text)
    weighted = F.aggregate("found", F.lit(0.0), lambda s, f: s + weight(f["severity"], f["family"]))
    out = listed.select(key, "found", F.size("found").cast("long").alias("findings"), weighted.alias("weighted"), n_words(t).alias("words"), n_contractions(t).alias("contractions"), n_first_person(t).alias("first_person"))
    return out.withColumns(points(F.col("weighted"), F.col("words"), F.col("contractions") + F.col("first_person")))


SUMS = "struct<words:bigint,findings:bigint,weighted:double,contractions:bigint,first_person:bigint>"


def detected_scores(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """What scored() gives for the findings of detected(), in one pass over the texts: no finding leaves its worker, and nothing is shuffled."""
    ship(docs.sparkSession)
    signs = [re.compile(p.replace("\\w", "[A-Za-z0-9_]")) for p in (WORD, CONTRACTION, FIRST_PERSON)]

    @F.arrow_udf(SUMS)
    def run(texts: pa.Array) -> pa.Array:
        d, rows = detector(settings), []
        for t in texts.to_pylist():
            found = d.find(t) if t else []
            words, contractions, first = (sum(1 for _ in p.finditer(t or "")) for p in signs)
            weighted = sum(SEVERITY.get(f[2], 1.0) * FAMILY.get(f[1], OTHER_FAMILY) for f in found)
            rows.append((words, len(found), weighted, contractions, first))
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["words", "findings", "weighted", "contractions", "first_person"])

    out = spread(docs.select(key, text)).select(key, run(F.coalesce(text, F.lit(""))).alias("x")).select(key, "x.*")
    out = out.withColumns(points(F.col("weighted"), F.col("words"), F.col("contractions") + F.col("first_person")))
    return out.select(key, "words", "findings", "contractions", "first_person", "density", "discount", "score", "band")


def by_family(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    return findings.groupBy(key, "family").agg(F.count("*").alias("n"))
