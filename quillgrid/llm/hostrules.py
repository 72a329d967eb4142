"""Quality rules, and their verdict on whole hosts.

Counts over each whole text give the rules that a document fails.  Failures are summed by host, a beta
prior fitted to all hosts shrinks each host's rate towards the common one (a host of few documents hardly
leaves it), and the host's verdict is joined back to its documents.

Edge cases: null and empty texts have no words and fail the least-words rule; documents of a null host
share one host; repeated rows count each time; an empty table gives no rows; ties cannot arise, as no
ranks are taken; only the named columns are read, so extra columns never clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid import ship
from quillgrid.llm.common import IS_SPACE, hashes, lean, settled, shingle_hashes, small, sums, utf8, word_counts

#: Rules of the base, in integers: least words, and most percent of words in repeated windows.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
SYMBOLS = b"#*$%&|<>"
#: A host goes if its shrunk rate of failing documents is above this.
MOST_FAILING = 0.6
FEATURES = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint>"

IS_SYMBOL = np.zeros(256, dtype=bool)
IS_SYMBOL[list(SYMBOLS)] = True


def repeated(w: list[bytes], width: int = WINDOW) -> int:
    """Words that stand in a window of width words found more than once in the text."""
    if len(w) <= width:
        return 0
    windows = shingle_hashes(hashes(w), width)
    _, at, n = np.unique(windows, return_inverse=True, return_counts=True)
    twice = n[at] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(w) + 1, dtype=np.int64)
    edge[:-width][twice] += 1
    edge[width:][twice] -= 1
    return int((np.cumsum(edge)[:-1] > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def counted(texts: pa.Array) -> pa.Array:
    data, at = utf8(texts)
    code_points = sums(((data & 0xC0) != 0x80).view(np.uint8), at)
    spaces = sums(IS_SPACE[data].view(np.uint8), at)
    raw = data.tobytes()
    each = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    columns = [
        word_counts(texts),
        code_points - spaces,
        sums(IS_SYMBOL[data].view(np.uint8), at),
        [duplicate_lines(t) for t in each],
        [repeated(t.split()) for t in each],
    ]
    return pa.StructArray.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


def fails() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def shrunk(hosts: DataFrame) -> DataFrame:
    """host, rate of hosts (host, n, failed): (failed + a) / (n + a + b), where a and b match mean and spread of the hosts' rates.

    The spread is what is left of the rates' variance (each host by its documents) without that of samples of the typical size.  Where
    nothing is left the hosts do not differ, and all have the common rate; where it is all there can be, a + b is 0 and rates stay."""
    r = F.col("failed") / F.col("n")
    prior = hosts.agg(
        (F.sum("failed") / F.sum("n")).alias("mean"),
        (F.sum(F.col("n") * r * r) / F.sum("n")).alias("square"),
        (F.count("*") / F.sum(1 / F.col("n"))).alias("typical"),
    ).first()
    if not prior or prior["mean"] is None:
        return hosts.select("host", F.lit(0.0).alias("rate"))
    mean, noise = prior["mean"], prior["mean"] * (1 - prior["mean"])
    spread = prior["square"] - mean**2 - noise / max(prior["typical"], 1.0)
    if spread <= 0:
        return hosts.select("host", F.lit(mean).alias("rate"))
    both = max(noise / spread - 1, 0.0)
    return hosts.select("host", ((F.col("failed") + mean * both) / (F.col("n") + both)).alias("rate"))


def judged(df: DataFrame, host: Column, text: str = "text", carry: tuple[str, ...] = ("doc_id",), most_failing: float = MOST_FAILING) -> DataFrame:
    """The columns of carry, host, the counts of the whole text, base_failed, host_rate and kept."""
    ship(df.sparkSession)
    counts = F.arrow_udf(lean(counted), FEATURES)
    rows = df.select(*carry, host.alias("host"), counts(F.coalesce(F.col(text), F.lit(""))).alias("counts")).select(*carry, "host", "counts.*")
    rows = settled(rows.withColumn("base_failed", fails()))
    hosts = settled(rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")))
    verdict = shrunk(hosts).select(F.col("host").alias("of"), F.col("rate").alias("host_rate"))
    out = rows.join(small(verdict), F.col("host").eqNullSafe(F.col("of")), "left").drop("of")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= most_failing))
