"""Findings as text for people and agents: built per document on the executors; only what is asked for reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.operators import detect

#: What a family is called.
LABELS = {"ai-slop": "Machine prose", "clarity": "Clarity", "style": "Style guide", "inclusive": "Inclusive language", "grounding": "Facts", "structure": "Structure", "grammar": "Grammar"}


# Rows that each list shows.
SHOWN = {"edges": 60, "edge checks": 15, "edge texts": 80, "agent": 10, "translations": 6, "rules": 6, "links": 3, "spans": 12, "grammar": 30, "regions": 3, "focus": 5}


def shown(rows: DataFrame, what: str, all_: bool = False) -> DataFrame:
    """The first rows of an ordered list, as many as such a list shows, unless all are asked for."""
    return rows if all_ else rows.limit(SHOWN[what])


def lines(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text: a header with counts, then findings by family in order."""
    return _lines(findings.groupBy(key).agg(F.collect_list(F.struct(*detect.COLUMNS)).alias("found")), key)


def documents_lines(docs: DataFrame, settings: detect.Settings = detect.Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """What lines() gives for the findings of detected(), in one pass over the texts and without a shuffle of findings."""
    return _lines(detect.listed(docs, settings, key, text).filter(F.size("found") > 0), key)


def _lines(per: DataFrame, key: str) -> DataFrame:
    names = ("line", "col", "rule_id", "severity", "message")
    order = F.sort_array(F.transform("found", lambda f: F.struct(f["family"].alias("family"), detect.rank(f["severity"]).alias("r"), *[f[n].alias(n) for n in names])))
    of = lambda s: lambda f: f["severity"] == s
    counts = [F.size(F.filter("found", of(s))).cast("long").alias(s) for s in detect.SEVERITIES]
    per = per.select(key, order.alias("all"), F.size("found").cast("long").alias("n"), *counts)
    label = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    shown = F.transform("all", lambda f: F.format_string("  %-20s L%-5d %-9s %-28s %s", F.coalesce(label[f["family"]], f["family"]), f["line"], f["severity"], f["rule_id"], f["message"]))
    head = F.format_string("%s: %d findings (%d error, %d warn, %d advisory)", F.col(key).cast("string"), "n", *detect.SEVERITIES)
    return per.select(key, F.concat_ws("\n", head, F.array_join(shown, "\n")).alias("text"))


def for_agent(findings: DataFrame, exemplars: DataFrame | None = None, key: str = "doc_id", most: int = 10) -> DataFrame:
    """key, text: the most important findings of each document, how many more there are, and, from exemplars (rule_id, bad, good), how to mend each rule shown."""
    return _for_agent(findings.groupBy(key).agg(F.collect_list(F.struct(*detect.COLUMNS)).alias("found")), exemplars, key, most)


def documents_for_agent(docs: DataFrame, settings: detect.Settings = detect.Settings(), exemplars: DataFrame | None = None, key: str = "doc_id", text: str = "text", most: int = 10) -> DataFrame:
    """What for_agent() gives for the findings of detected(), in one pass over the texts and without a shuffle of findings."""
    return _for_agent(detect.listed(docs, settings, key, text).filter(F.size("found") > 0), exemplars, key, most)


def _for_agent(per: DataFrame, exemplars: DataFrame | None, key: str, most: int) -> DataFrame:
    """Exemplars, a few for each rule, are one row beside every document."""
    names = ("line", "col", "rule_id", "severity", "message")
    order = F.sort_array(F.transform("found", lambda f: F.struct(detect.rank(f["severity"]).alias("r"), *[f[n].alias(n) for n in names])))
    per = per.select(key, F.slice(order, 1, most).alias("f"), F.size("found").cast("long").alias("n"))
    shown = F.array_join(F.transform("f", lambda f: F.format_string("  L%d %s %s %s", f["line"], f["severity"], f["rule_id"], f["message"])), "\n")
    more = F.when(F.col("n") > most, F.format_string("\n  (%d more)", F.col("n") - most)).otherwise("")
    if exemplars is None:
        return per.select(key, F.concat(shown, more).alias("text"))
    how = F.format_string("  %s\n    - %s\n    + %s", "rule_id", "bad", "good")
    per = per.crossJoin(F.broadcast(exemplars.agg(F.collect_list(F.struct("rule_id", how.alias("how"))).alias("e"))))
    told = F.filter("e", lambda e: F.exists("f", lambda f: f["rule_id"] == e["rule_id"]))
    told = F.array_join(F.sort_array(F.transform(told, lambda e: e["how"])), "\n")
    return per.select(key, F.concat(shown, more, F.when(told != "", F.concat(F.lit("\n\n"), told)).otherwise("")).alias("text"))


def score_lines(scores: DataFrame, key: str = "doc_id") -> DataFrame:
    return scores.select(key, F.format_string("%s: %d/100 (%s), %d findings in %d words", F.col(key).cast("string"), "score", "band", "findings", "words").alias("text"))
