"""The detector: documents in, typed findings out.

All rules' literals are looked for in one pass of an automaton over each text; only rules of which a literal
occurs run their patterns.  The work is per document, in Arrow batches, without any shuffle: duplicates of a
rule at one offset are dropped before rows leave the worker.  What follows (ignores, order, sums) is DataFrames.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid import ship
from quillgrid.functions.segment import BLANKS, Document, beyond_latin
from quillgrid.plans.rules import RULES, Rule
from quillgrid.plans.session import spread

SEVERITIES = ("error", "warn", "advisory")
FINDING = "array<struct<rule_id:string,family:string,severity:string,line:int,col:int,offset:int,length:int,span:string,message:string,seq:int>>"
COLUMNS = ("rule_id", "family", "severity", "line", "col", "offset", "length", "span", "message", "seq")
_SPACES = re.compile(f"[{BLANKS}]+")


@dataclass(frozen=True)
class Settings:
    """Style guide, rules and values to ignore; values by rule, matched inside a finding's span whatever their case."""

    style: str = "microsoft"
    ignore_rules: frozenset[str] = frozenset()
    ignore_values: tuple[tuple[str, tuple[str, ...]], ...] = ()
    only: frozenset[str] | None = None
    #: Words that microsoft-adverbs looks for, in place of its rule.
    adverbs: frozenset[str] | None = None


def active(settings: Settings, rules: list[Rule] = RULES) -> list[tuple[int, Rule]]:
    """The rules that the plan holds: ignored ones and those of other style guides never enter it."""
    return [(k, r) for k, r in enumerate(rules) if r.id not in settings.ignore_rules and r.pack in (None, settings.style) and (settings.only is None or r.id in settings.only)]


class Detector:
    def __init__(self, settings: Settings) -> None:
        self.settings = settings
        self.rules = active(settings)
        self.always = [k for k, (_, r) in enumerate(self.rules) if not r.needs]
        by_literal: dict[str, set[int]] = {}
        for k, (_, r) in enumerate(self.rules):
            for word in r.needs:
                by_literal.setdefault(word, set()).add(k)
        self.automaton = ahocorasick.Automaton()
        for word, ks in by_literal.items():
            self.automaton.add_word(word, frozenset(ks))
        if by_literal:
            self.automaton.make_automaton()
        self.ignored = {rule: [v.lower() for v in values] for rule, values in settings.ignore_values}

    def candidates(self, lower: str) -> list[int]:
        out, seen = set(self.always), set()
        if len(self.automaton):
            for _, ks in self.automaton.iter(lower):
                if ks not in seen:
                    seen.add(ks)
                    out |= ks
        return sorted(out)

    def find(self, text: str) -> list[tuple]:
        doc = Document(text, self.settings.style, self.settings.adverbs)
        if beyond_latin(doc.masked):
            return []
        out = []
        # raw text as well: some rules look at what masking hides
        lower = doc.lower if doc.masked is doc.text else doc.lower + "\n" + text.lower()
        for k in self.candidates(lower):
            seq, rule = self.rules[k]
            seen = set()
            for offset, length, severity, values in rule.search(doc):
                if offset in seen:
                    continue
                seen.add(offset)
                span = values["name"] if rule.named else _SPACES.sub(" ", text[offset : offset + min(length, 80)]).strip(" ")
                if any(v in span.lower() for v in self.ignored.get(rule.id, ())):
                    continue
                line, col = doc.place(offset)
                out.append((rule.id, rule.family, severity or rule.severity, line, col, offset, length, span, rule.message.format_map(_Values(values)), seq))
        return out


class _Values(dict):
    """Values of a message by name or number."""

    def __init__(self, values: dict) -> None:
        super().__init__(values)

    def __missing__(self, key: str) -> str:
        return ""


_detectors: dict[Settings, Detector] = {}


def detector(settings: Settings) -> Detector:
    if settings not in _detectors:
        _detectors[settings] = Detector(settings)
    return _detectors[settings]


def findings_udf(settings: Settings = Settings()):
    @F.arrow_udf(FINDING)
    def find(texts: pa.Array) -> pa.Array:
        d = detector(settings)
        rows = [d.find(t) if t else [] for t in texts.to_pylist()]
        flat = [x for r in rows for x in r]
        at = [0]
        for r in rows:
            at.append(at[-1] + len(r))
        kinds = [pa.string()] * 3 + [pa.int32()] * 4 + [pa.string()] * 2 + [pa.int32()]
        columns = list(zip(*flat, strict=True)) if flat else [[]] * len(COLUMNS)
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(COLUMNS)))

    return find


def looks_like_data(text: Column) -> Column:
    """Dumps rather than prose: at least 100 words, and a line over 2000 characters or fewer than one sentence end for 200 words."""
    words = F.regexp_count(text, F.lit("[A-Za-z]{2,}"))
    ends = F.regexp_count(text, F.lit(r"[.!?](?=\s|\z)"))
    longest = F.array_max(F.transform(F.split(text, "\n", -1), lambda line: F.length(line)))
    return (words >= 100) & ((longest > 2000) | (ends < words / 200))


def detected(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each finding of docs: key and the columns of a finding."""
    ship(docs.sparkSession)
    find = findings_udf(settings)
    return spread(docs.select(key, text)).select(F.col(key), F.inline(find(F.coalesce(text, F.lit("")))))


def listed(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, found: every one of docs with the array of its findings, for what is made of one document's findings: these are together as they are found, so no group or join has to bring them together again."""
    ship(docs.sparkSession)
    # not to be moved: a filter on found would else run the detector once more
    find = findings_udf(settings).asNondeterministic()
    return spread(docs.select(key, text)).withColumn("found", find(F.coalesce(text, F.lit(""))))


def rank(severity: Column) -> Column:
    return F.when(severity == "error", 0).when(severity == "warn", 1).when(severity == "advisory", 2).otherwise(3)


def ordered(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    return findings.orderBy(key, rank(F.col("severity")), "line", "col", "rule_id")


def merged(*kinds: DataFrame, key: str = "doc_id") -> DataFrame:
    """Findings of several checkers of an edit in one order: the most severe first, then by line, so that a cut drops what matters least."""
    out = kinds[0]
    for more in kinds[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out.orderBy(key, rank(F.col("severity")), "line")


def deduplicated(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """The first finding of each rule and offset by seq, for findings from several detectors."""
    first = F.min_by(F.struct(*[F.col(c) for c in findings.columns]), "seq")
    return findings.groupBy(key, "rule_id", "offset").agg(first.alias("f")).select("f.*")


def without_values(findings: DataFrame, values: DataFrame) -> DataFrame:
    """Findings but those whose span holds a value (rule_id, value) that their rule ignores."""
    v = F.broadcast(values.limit(10_000)) if values.count() <= 10_000 else values
    return findings.join(v.withColumnRenamed("rule_id", "of"), (F.col("rule_id") == F.col("of")) & (F.instr(F.lower("span"), F.lower("value")) > 0), "left_anti")


def summary(findings: DataFrame) -> DataFrame:
    counts = [F.sum((F.col("severity") == s).cast("long")).alias(s) for s in SEVERITIES]
    return findings.agg(*[F.coalesce(c, F.lit(0)).alias(s) for c, s in zip(counts, SEVERITIES, strict=True)])


def worst(findings: DataFrame, key: str = "doc_id", most: int = 12) -> DataFrame:
    per = findings.groupBy(key).agg(F.count("*").alias("n"), F.sum((F.col("severity") == "error").cast("long")).alias("errors"))
    return per.orderBy(F.desc("errors"), F.desc("n"), key).limit(most)


def histogram(findings: DataFrame, most: int = 15) -> DataFrame:
    return findings.groupBy("rule_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule_id").limit(most)


def registry(spark) -> DataFrame:
    return spark.createDataFrame([(r.id, r.family, r.severity, r.pack) for r in RULES], "rule_id string, family string, severity string, pack string")
