"""Places for models: each takes a function over batches of texts, so that any runtime can be put in, and none is needed for the rest."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid import ship
from quillgrid.operators import grounding
from quillgrid.operators.detect import Settings, findings_udf, rank
from quillgrid.plans import lexicons as L
from quillgrid.plans.session import accumulated

# Thresholds of the model tiers.
CONTRADICTS, ENTAILS, LOOKBACK, SHORTEST_CLAIM, SLOP, SHORTEST_SPAN = 0.6, 0.55, 0.10, 12, 0.15, 12
MIDDLE, WIDTH = 50.0, 22.0


def machine_score(perplexity: Column) -> Column:
    """How machine-like a perplexity is, 0 to 1."""
    return 1 / (1 + F.exp((perplexity - MIDDLE) / WIDTH))


def perplexity(windows: DataFrame, key: str = "doc_id", most: int = 4) -> DataFrame:
    """key, perplexity of windows (key, window, loss, tokens): the mean loss of the first ones by tokens."""
    rows = windows.filter(F.col("window") < most)
    return rows.groupBy(key).agg(F.exp(F.sum(F.col("loss") * F.col("tokens")) / F.sum("tokens")).alias("perplexity"))


def entailed(docs: DataFrame, fact_rows: DataFrame, judge: Callable[[list[str], list[str]], list[tuple[float, float]]], key: str = "doc_id", decomposed: DataFrame | None = None) -> DataFrame:
    """Findings by entailment: judge(facts, claims) gives (contradiction, entailment) for pairs.  decomposed (key, n, claims) replaces sentences by their claims where it has any."""
    ship(docs.sparkSession)
    table, rows = grounding.facts(fact_rows), grounding.claims(docs, key)
    if decomposed is not None:
        rows = rows.join(decomposed, [key, "n"], "left")
        each = F.when(F.size("claims") > 0, F.slice(F.array_distinct("claims"), 1, 8)).otherwise(F.array("text"))
        read = F.arrow_udf(grounding.parsed, grounding.PARSED)
        rows = rows.withColumn("text", F.explode(each)).withColumn("p", read("text")).select(key, "n", "start", "line", "col", "text", "p.*")
    rows = rows.filter((F.size("tokens") >= 2) | (F.size("entities") >= 1)).withColumn("claim", F.xxhash64(key, "n", "text"))
    best = grounding.best(rows.select("claim", F.lit(0).alias("n"), "tokens", "entities"), table, "claim").filter((F.col("score") >= grounding.LEAST_SCORE) & (F.col("shared") >= grounding.LEAST_SHARED))
    met = rows.join(best.select("claim", "fact"), "claim").join(table.select("fact", "fact_text"), "fact")

    @F.arrow_udf("struct<contradiction:double,entailment:double>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        said = judge(a.to_pylist(), b.to_pylist())
        return pa.array([{"contradiction": float(x), "entailment": float(y)} for x, y in said], pa.struct([("contradiction", pa.float64()), ("entailment", pa.float64())]))

    told = met.withColumn("j", run("fact_text", "text"))
    against = (F.col("j.contradiction") >= CONTRADICTS) & (F.col("j.contradiction") > F.col("j.entailment"))
    rule = F.when(against, "contradicts-fact").when(F.col("j.entailment") < ENTAILS, "unsupported-claim")
    out = told.select(key, rule.alias("rule_id"), F.lit("grounding").alias("family"), F.when(against, "error").otherwise("advisory").alias("severity"), "line", "col", F.col("start").alias("offset"), "text")
    return out.filter("rule_id IS NOT NULL").dropDuplicates([key, "rule_id", "offset", "text"])


def ungrounded(docs: DataFrame, context: Callable[[list[str]], list[float]], key: str = "doc_id") -> DataFrame:
    """Sentences of 12 characters or more that context(sentences) scores below the threshold."""
    rows = grounding.claims(docs, key).filter(F.length("text") >= SHORTEST_CLAIM)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([float(x) for x in context(texts.to_pylist())], pa.float64())

    out = rows.withColumn("score", run("text")).filter(F.col("score") < LOOKBACK)
    return out.select(key, F.lit("ungrounded-span").alias("rule_id"), F.lit("grounding").alias("family"), F.lit("warn").alias("severity"), "line", "col", F.col("start").alias("offset"), F.length("text").alias("length"), "score")


def slop_spans(spans: DataFrame, findings: DataFrame, key: str = "doc_id", most: int = 12) -> DataFrame:
    """Spans (key, start, end, text, score) of several words and some score that overlap no finding on machine prose, the best of each document."""
    rows = spans.filter((F.col("score") >= SLOP) & F.trim("text").rlike(r"\s"))
    f = findings.filter("family = 'ai-slop'").select(F.col(key).alias("of"), "offset", "length")
    free = rows.join(f, (F.col(key) == F.col("of")) & (F.col("start") < F.col("offset") + F.col("length")) & (F.col("end") > F.col("offset")), "left_anti")
    order = Window.partitionBy(key).orderBy(F.desc("score"), "start")
    return free.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("place")


def paragraphs(text: Column, longest: int = 1000) -> Column:
    """Paragraphs for span models: no headings, tables or code; long ones cut."""
    prose = F.regexp_replace(text, r"(?s)```.*?```|~~~.*?~~~", "")
    parts = F.filter(F.transform(F.split(prose, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: (p != "") & ~p.rlike(r"^\s{0,3}#{1,6}\s") & ~p.rlike(r"^\s*\|"))
    return F.flatten(F.transform(parts, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / longest).cast("int")), lambda k: F.substring(p, k * longest + 1, longest))))


# The layers that tell where attention goes, as shares of all.
LOWEST_LAYER, HIGHEST_LAYER = 0.60, 0.88


def scanned(captures: DataFrame, layers: int, queries: DataFrame, context: DataFrame, low: float = LOWEST_LAYER, high: float = HIGHEST_LAYER, sinks: bool = True, normalized: bool = True) -> DataFrame:
    """scan, q, c, score: the attention of query chunks to context chunks, from what a model's layers gave (captures: scan, layer, head, q, c, weight, by position).

    Layers of the band from low to high of all are averaged; with the chunk of each query position (queries: scan, q, chunk) and context
    position (context: scan, c, to), columns that draw attention whatever the query are masked, weights summed by chunk, and columns
    that all rows attend to held down."""
    band = captures.filter((F.col("layer") >= F.floor(F.lit(low * layers))) & (F.col("layer") <= F.floor(F.lit(high * layers))))
    matrix = averaged(band).join(queries, ["scan", "q"])
    cells = scattered(without_sinks(matrix) if sinks else matrix, context)
    return by_prior(cells) if normalized else cells


# Shares that flag, least characters of a region and of a query, rows from which priors count.
SHARE, REGION, QUERY, PRIOR_ROWS, POWER, SIGMAS = 0.3, 12, 8, 3, 0.75, 3.0


def averaged(captures: DataFrame) -> DataFrame:
    """scan, q, c, weight of captured attention (scan, layer, head, q, c, weight): the mean over layers and heads."""
    heads = captures.groupBy("scan").agg(F.count_distinct("layer", "head").alias("heads"))
    return captures.groupBy("scan", "q", "c").agg(F.sum("weight").alias("weight")).join(F.broadcast(heads), "scan").select("scan", "q", "c", (F.col("weight") / F.col("heads")).alias("weight"))


def without_sinks(matrix: DataFrame, sigmas: float = SIGMAS) -> DataFrame:
    """matrix (scan, chunk, q, c, weight, all cells) with 0 for columns that draw attention whatever the query: those whose upper median over the chunk's rows is, by logarithm, over mean + 3 sigma of all columns'."""
    middle = matrix.groupBy("scan", "chunk", "c").agg(F.sort_array(F.collect_list("weight")).alias("w")).select("scan", "chunk", "c", F.element_at("w", (F.floor(F.size("w") / 2) + 1).cast("int")).alias("median"))
    by = ["scan", "chunk"]
    least = middle.groupBy(*by).agg(F.least(F.lit(1e-12), F.min(F.when(F.col("median") > 0, F.col("median")))).alias("least"))
    logs = middle.join(least, by).withColumn("log", F.log(F.col("median") + (F.col("least") / 2 + 1e-12)))
    line = logs.groupBy(*by).agg((F.avg("log") + sigmas * F.stddev_pop("log")).alias("line"))
    sinks = logs.join(line, by).filter("log > line").select(*by, "c", F.lit(True).alias("sink"))
    out = matrix.join(sinks, [*by, "c"], "left")
    return out.withColumn("weight", F.when(F.col("sink"), 0.0).otherwise(F.col("weight"))).drop("sink").select(*matrix.columns)


def scattered(matrix: DataFrame, context: DataFrame) -> DataFrame:
    """scan, q (a query chunk), c (a context chunk), score of matrix (scan, chunk, q, c, weight), given the context chunk of each position (scan, c, to): the mean over the query chunk's rows, summed over each context chunk, as a share of the row."""
    rows = matrix.groupBy("scan", "chunk").agg(F.count_distinct("q").alias("rows"))
    sums = matrix.join(context, ["scan", "c"]).groupBy("scan", "chunk", "to").agg(F.sum("weight").alias("sum"))
    cells = sums.join(rows, ["scan", "chunk"]).select("scan", F.col("chunk").alias("q"), F.col("to").alias("c"), (F.col("sum") / F.col("rows")).alias("score"))
    return shares(cells)


def shares(cells: DataFrame) -> DataFrame:
    """Scores of each row (scan, q) as shares of its sum."""
    total = F.sum("score").over(Window.partitionBy("scan", "q"))
    return cells.withColumn("score", F.when(total > 0, F.col("score") / total).otherwise(F.col("score")))


def by_prior(cells: DataFrame, power: float = POWER, least_rows: int = PRIOR_ROWS) -> DataFrame:
    """Scores (scan, q, c, score) divided by a power of their column's mean over positive cells, as shares of their rows; scans of fewer rows stay as they are."""
    prior = cells.filter("score > 0").groupBy("scan", "c").agg(F.avg("score").alias("prior"))
    rows = cells.groupBy("scan").agg(F.count_distinct("q").alias("rows"))
    out = cells.join(prior, ["scan", "c"], "left").join(rows, "scan")
    adjusted = F.when(F.col("score") > 0, F.col("score") / F.pow("prior", F.lit(power))).otherwise(0.0)
    made = shares(out.withColumn("was", F.col("score")).withColumn("score", adjusted))
    return made.select("scan", "q", "c", F.when(F.col("rows") < least_rows, F.col("was")).otherwise(F.col("score")).alias("score"))


def coverage(attention: DataFrame, by: str, threshold: float = SHARE, scan: str | None = None) -> DataFrame:
    """by, share, flagged of attention (q, c, score, and scan if named): sums over the other side, relative to the largest of the scan.  by c: what of the context the queries attend to; by q: which queries have ground in it."""
    keys = [scan] if scan else []
    sums = attention.groupBy(*keys, by).agg(F.sum("score").alias("sum"))
    top = F.lit(sums.agg(F.max("sum")).first()[0]).cast("double") if not scan else F.max("sum").over(Window.partitionBy(scan))
    return sums.select(*keys, by, (F.col("sum") / F.when(top > 0, top)).alias("share")).withColumn("flagged", F.coalesce(F.col("share") < threshold, F.lit(True)))


def regions(flags: DataFrame, by: str, texts: DataFrame | None = None, scan: str | None = None, least: int = REGION) -> DataFrame:
    """first, last, low, high of runs of flagged neighbours (share, flagged by the column by), of each scan if named.  With texts (by, text, and scan) their text, and only runs of at least so many characters."""
    keys = [scan] if scan else []
    rows = flags.filter("flagged")
    rows = rows if texts is None else rows.join(texts, [*keys, by])
    # neighbours of one run are as far from their rank as each other
    if scan:
        rank = F.row_number().over(Window.partitionBy(scan).orderBy(by))
        rows = rows.withColumn("island", F.col(by) - rank)
    else:
        rows = accumulated(rows, [F.col(by)], island=F.lit(1)).withColumn("island", F.col(by) - F.col("island"))
    said = [] if texts is None else [F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(by, "text"))), lambda x: x["text"]), "").alias("text")]
    out = rows.groupBy(*keys, "island").agg(F.min(by).alias("first"), F.max(by).alias("last"), F.min("share").alias("low"), F.max("share").alias("high"), *said).drop("island")
    out = out if texts is None else out.filter(F.length("text") >= least)
    return out.orderBy(*keys, "first")


def focused(attention: DataFrame, texts: DataFrame, threshold: float = 0.6, scan: str = "scan", most: int | None = None) -> DataFrame:
    """scan, first, last, score, text: runs of the context that the queries attend to most (at least threshold of the scan's peak), the best first; at most so many of each scan."""
    flags = coverage(attention, "c", threshold, scan).withColumn("flagged", ~F.col("flagged"))
    out = regions(flags, "c", texts, scan).withColumnRenamed("high", "score").drop("low")
    order = Window.partitionBy(scan).orderBy(F.desc("score"), "first")
    out = out.withColumn("place", F.row_number().over(order))
    out = out if most is None else out.filter(F.col("place") <= most)
    return out.orderBy(scan, "place").drop("place")


def unanchored(attention: DataFrame, queries: DataFrame, threshold: float = SHARE, scan: str = "scan", least: int = QUERY) -> DataFrame:
    """scan, q, share, text of queries (scan, q, text) of some length that pay little attention to the context."""
    flags = coverage(attention, "q", threshold, scan).filter("flagged").drop("flagged")
    return flags.join(queries, [scan, "q"]).filter(F.length("text") >= least).orderBy(scan, "q")


def engaged(flags: DataFrame) -> DataFrame:
    return flags.agg((1 - F.sum(F.col("flagged").cast("double")) / F.count("*")).alias("engaged"))


#: Best regions of a side that a span is narrowed to.
BEST = 3


def narrowed(edges: DataFrame, spans: DataFrame, margin: int = 1, least: int = 8) -> DataFrame:
    """id and new ends of edges, given attended regions (spans: id, side, first, last, score) of their lines: from the first to the last of the three best, and a line around; long spans only, and only inwards."""
    order = Window.partitionBy("id", "side").orderBy(F.desc("score"), "first")
    per = spans.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= BEST).groupBy("id", "side").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    out = edges.select("id", *[F.col(f"{s}_{c}").alias(f"{s}_{c}_") for s in ("src", "dst") for c in ("start", "end")])
    for s in ("src", "dst"):
        part = per.filter(F.col("side") == s).select("id", F.col("first").alias(f"{s}_a"), F.col("last").alias(f"{s}_b"))
        out = out.join(part, "id", "left")
        a, b = F.greatest(f"{s}_start_", F.col(f"{s}_a") - margin), F.least(f"{s}_end_", F.col(f"{s}_b") + margin)
        tighter = F.col(f"{s}_a").isNotNull() & (F.col(f"{s}_end_") - F.col(f"{s}_start_") >= least) & (b - a < F.col(f"{s}_end_") - F.col(f"{s}_start_"))
        out = out.withColumns({f"{s}_start": F.when(tighter, a), f"{s}_end": F.when(tighter, b)})
    return out.select("id", "src_start", "src_end", "dst_start", "dst_end").filter("src_start IS NOT NULL OR dst_start IS NOT NULL")


def variants(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n (from 1), text, tighter (null: it is tight already), flags (rule ids, in order) of every sentence, looked at alone."""
    rows = grounding.claims(docs, key, text).filter("text <> ''").select(key, (F.row_number().over(Window.partitionBy(key).orderBy("n"))).alias("n"), "text")
    tighter = tightened(F.col("text"), [L.WORDY, L.NOMINAL, L.COMPLEX, L.WORD_SWAP])
    found = findings_udf(settings)("text")
    flags = F.array_distinct(F.transform(F.sort_array(F.transform(found, lambda f: F.struct(rank(f["severity"]), f["line"], f["col"], f["rule_id"].alias("r")))), lambda f: f["r"]))
    return rows.select(key, "n", "text", F.when(tighter != F.col("text"), tighter).alias("tighter"), flags.alias("flags"))


# Kinds and rules of a grammar checker that are kept or left out, and findings of a document.
GRAMMAR_KINDS = ("Agreement", "Grammar", "Miscellaneous", "Eggcorn", "Malapropism", "Nonstandard", "BoundaryError", "Redundancy")
GRAMMAR_OFF = ("MassNouns", "MissingPreposition")
MOST_GRAMMAR = 30


def grammar(docs: DataFrame, check: Callable[[list[str]], list[list[dict]]], kinds: tuple[str, ...] = GRAMMAR_KINDS, severity: str = "warn", most: int = MOST_GRAMMAR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Findings of a grammar checker: check(texts) gives for each text lints (kind, rule, start, end, message, suggestions) in code points; of the kinds kept, the first ones of each document.  A text that check fails on has none."""
    ship(docs.sparkSession)
    lint = "array<struct<kind:string,rule:string,start:int,end:int,message:string,suggestions:array<string>>>"
    shape = pa.list_(pa.struct([("kind", pa.string()), ("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("message", pa.string()), ("suggestions", pa.list_(pa.string()))]))

    @F.arrow_udf(lint)
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                out.append(check([t or ""])[0])
            except Exception:  # noqa: BLE001 - a checker never breaks detection
                out.append([])
        return pa.array(out, shape)

    kept = F.filter(run(F.coalesce(text, F.lit(""))), lambda x: x["kind"].isin(*kinds) & ~F.coalesce(x["rule"].isin(*GRAMMAR_OFF), F.lit(False)))
    first = F.slice(F.array_sort(kept, lambda a, b: a["start"] - b["start"]), 1, most)
    rows = docs.select(key, text, F.posexplode(first).alias("seq", "x"))
    head = F.substring(text, F.lit(1), F.col("x.start"))
    line = F.size(F.split(head, "\n", -1))
    col = F.length(F.element_at(F.split(head, "\n", -1), -1)) + 1
    span = F.substring(F.trim(F.regexp_replace(F.substring(text, F.col("x.start") + 1, F.col("x.end") - F.col("x.start")), r"\s+", " ")), 1, 80)
    offered = F.slice(F.filter("x.suggestions", lambda s: s.isNotNull()), 1, 3)
    fix = F.when(F.size(offered) > 0, F.concat(F.lit(" Suggested: "), F.array_join(F.transform(offered, lambda s: F.when(s == "", "(remove)").otherwise(F.concat(F.lit('"'), s, F.lit('"')))), " / "), F.lit("."))).otherwise("")
    return rows.select(
        key, F.concat(F.lit("grammar-"), F.lower("x.kind")).alias("rule_id"), F.lit("grammar").alias("family"), F.lit(severity).alias("severity"), line.alias("line"), col.alias("col"), F.col("x.start").alias("offset"), (F.col("x.end") - F.col("x.start")).alias("length"), span.alias("span"), F.concat("x.message", fix).alias("message"), "seq",
    )


def tightened(text: Column, tables: list[dict[str, str]]) -> Column:
    """A sentence with each table's phrases replaced in turn, and white space evened out."""
    out = text
    for table in tables:
        for old, new in sorted(table.items(), key=lambda kv: -len(kv[0])):
            out = F.regexp_replace(out, rf"(?i)(?<![A-Za-z0-9_])\Q{old}\E(?![A-Za-z0-9_])", new.replace("\\", r"\\").replace("$", r"\$"))
    return F.trim(F.regexp_replace(out, r"\s+", " "))




class Sidecar:
    """A model that runs beside a worker: a program that reads a JSON request a line and answers with a JSON line of the same id, in any order.

    It is started with a worker's first batch, and again if it ends; called with texts it returns what the answers hold under result."""

    def __init__(self, command: list[str], operation: str = "run") -> None:
        self.command, self.operation, self.process, self.n = command, operation, None, 0

    def __getstate__(self) -> dict:
        return {"command": self.command, "operation": self.operation, "process": None, "n": 0}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    def __call__(self, *columns: list) -> list:
        if self.process is None or self.process.poll() is not None:
            self.process = subprocess.Popen(self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True)
        self.n += 1
        self.process.stdin.write(json.dumps({"id": self.n, "op": self.operation, "args": columns}) + "\n")
        self.process.stdin.flush()
        while line := self.process.stdout.readline():
            answer = json.loads(line)
            if answer.get("id") == self.n:
                if "error" in answer:
                    raise RuntimeError(answer["error"])
                return answer["result"]
        raise RuntimeError("the model's program ended without an answer")
