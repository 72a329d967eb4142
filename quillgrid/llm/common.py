"""Helpers that the corpus operators share: words, Arrow text buffers, checkpoints, row packing."""

from __future__ import annotations

import functools
import inspect
import tempfile
import threading
import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid import ship

#: White space that separates words: space and \t to \r.
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True

ROW = "__packed_row"


def ready(spark: SparkSession) -> None:
    """Makes checkpoint() usable: the cluster's folder, or a temporary one if Spark runs in this process alone."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="quillgrid-checkpoint-")
    sc.setCheckpointDir(named)


def settled(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder: later reads survive lost executors.

    Its columns travel as one struct, so that the result claims no partitioning: adaptive execution may have
    merged partitions since the plan was made, and joins that trust an old number of them fail."""
    ready(ship(df.sparkSession))
    return df.select(packed(df)).checkpoint(eager=True).select(f"{ROW}.*")


#: What a worker remembers for one operator, by its name: how to forget it.  It is forgotten when the worker serves another operator, and when it has had nothing to do for so many seconds.
HELD: dict[str, Callable[[], None]] = {}
IDLE = 1.0
_state = {"busy": 0, "since": 0.0, "watched": False}


def forget(owner: str = "") -> None:
    """Lets go of what operators other than the owner hold."""
    for name in [n for n in list(HELD) if n != owner]:
        if clear := HELD.pop(name, None):
            clear()


def _watch() -> None:
    while HELD:
        time.sleep(IDLE / 2)
        if not _state["busy"] and time.monotonic() - _state["since"] > IDLE:
            forget()
            pa.default_memory_pool().release_unused()
    _state["watched"] = False


def hold(name: str, clear: Callable[[], None]) -> None:
    HELD[name] = clear
    if not _state["watched"]:
        _state["watched"] = True
        threading.Thread(target=_watch, daemon=True).start()


def lean(f, owner: str = ""):
    """f, for Python workers, which stay and serve one operator after the other: what Arrow's memory pool holds after a batch is given back, and what other operators than the owner remember is forgotten."""

    @functools.wraps(f)
    def run(*columns):
        _state["busy"] += 1
        try:
            forget(owner)
            return f(*columns)
        finally:
            _state["busy"] -= 1
            _state["since"] = time.monotonic()
            pa.default_memory_pool().release_unused()

    @functools.wraps(f)
    def run_one(column):
        return run(column)

    # Spark counts the parameters of what it groups for
    return run_one if len(inspect.signature(f).parameters) == 1 and "*" not in str(inspect.signature(f)) else run


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls count as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array.cast(pa.large_string()), "")
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[array.offset : array.offset + len(array) + 1] if offsets is not None and len(array) else np.zeros(1, dtype=np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8))[at[0] : at[-1]], at - at[0]


def slices(texts: pa.Array, rows: int, size: int = 4 << 20) -> list[tuple[int, int]]:
    """Start and length of runs of at most so many texts, and so many bytes where more than one text is in it."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    out, start, total = [], 0, 0
    for k, n in enumerate(lengths):
        if k > start and (k - start >= rows or total + n > size):
            out.append((start, k - start))
            start, total = k, 0
        total += n
    if len(lengths) > start:
        out.append((start, len(lengths) - start))
    return out


def sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of flags within each [at[i], at[i+1])."""
    out, full = np.zeros(len(at) - 1, dtype=np.int64), at[1:] > at[:-1]
    if full.any():
        out[full] = np.add.reduceat(flags, at[:-1][full], dtype=np.int64)
    return out


def word_counts(array: pa.Array) -> np.ndarray:
    """Number of maximal runs of other bytes than SPACES in each text."""
    data, at = utf8(array)
    inside = ~IS_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    firsts = at[:-1][at[1:] > at[:-1]]
    starts[firsts] = inside[firsts]
    return sums(starts.view(np.uint8), at)


@F.arrow_udf(T.LongType())
@lean
def n_words(texts: pa.Array) -> pa.Array:
    return pa.array(word_counts(texts), type=pa.int64())


def words(text: str | None) -> list[bytes]:
    """UTF-8 words of a text; null has none."""
    return text.encode().split() if text else []


def hashes(items: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, items), dtype=np.uint64, count=len(items))


MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(w: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of each run of width word hashes; of the whole if it is shorter."""
    if not len(w):
        return w
    width = min(width, len(w))
    n = len(w) - width + 1
    out = np.full(n, np.uint64(width), dtype=np.uint64)
    for k in range(width):
        out = (out ^ w[k : k + n]) * MIX
        out ^= out >> np.uint64(29)
    return out


def packed(df: DataFrame) -> Column:
    """The whole row as one struct, so that columns added later cannot clash with its names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW)


def unpacked(df: DataFrame, **changed: Column) -> DataFrame:
    """The columns that packed() put away; changed ones take another value."""
    names = df.schema[ROW].dataType.names
    return df.select(*[(changed[c] if c in changed else F.col(f"{ROW}.`{c}`")).alias(c) for c in names])


#: Rows of a small table by key (sources, hosts, shares) up to which it is broadcast.
MOST_BROADCAST = 50_000


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df, marked for broadcast if a count shows that it has at most so many rows; else it is joined by key, and skewed keys are split."""
    return F.broadcast(df) if df.count() <= most else df


#: Bits of a sieve, in words of 64: 131,072 rows at most, whatever goes in.
SIEVE = 1 << 23


def _sifted(df: DataFrame, column: str, wanted: DataFrame, key: str, how: str) -> DataFrame:
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE))
    words = wanted.select(bit(F.col(key)).alias("b")).groupBy(F.shiftright("b", 6).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("__mask"))
    rows = df.withColumn("__bit", bit(F.col(column))).withColumn("__word", F.shiftright("__bit", 6))
    return rows.join(F.broadcast(words), "__word", how).withColumn("__hit", F.expr("coalesce(shiftright(__mask, cast(__bit & 63 as int)) & 1, 0) = 1"))


def sieved(df: DataFrame, column: str, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of df whose column may be among the keys of wanted, so that the rest need no shuffle.  A bitmap of hashed keys, of bounded size, is broadcast; some other rows pass, and all do if there are very many keys, so an exact join has to follow."""
    return _sifted(df, column, wanted, key, "inner").filter("__hit").drop("__bit", "__word", "__mask", "__hit")


def parted(df: DataFrame, column: str, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of df that sieved() lets through, and the others, whose column is surely not among the keys."""
    rows = _sifted(df, column, wanted, key, "left")
    return tuple(rows.filter(c).drop("__bit", "__word", "__mask", "__hit") for c in ("__hit", "not __hit"))
