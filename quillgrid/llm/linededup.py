"""Line dedup by windows of three lines.

Lines that hold a word are numbered within their text.  Every three consecutive ones are hashed; a window
found before, in an earlier document or further up, is a repeat.  The positions that a document's repeats
cover are merged and those lines removed.  The first occurrence, by doc_id and position, stays.

Such windows miss a long passage on one or two lines between others.  With a number of words, shorter runs of
lines with more words than that are compared too: one line, or two of which neither has them alone.  Texts of
fewer lines than a window are then one window, whatever their words.

Edge cases: blank lines are no part of windows and stay where they are; texts of fewer lines than a window
(but see above), null and empty texts are left alone; a null doc_id comes after all others; rows equal in doc_id and text
are one occurrence and change alike; the order among texts of one doc_id is that of a hash of the text;
an empty table gives no rows; all columns are kept, whatever their names (the count of removed lines gives way).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid import ship
from quillgrid.llm.common import ROW, lean, packed, parted, settled

WIDTH = 3
#: Words above which a passage counts whatever its lines.
PASSAGE = 50


def worded(text: str) -> list[str]:
    return [x for x in text.split("\n") if x and not x.encode().isspace()]


def windows(width: int, passage: int | None = None):
    """Of each text a list of (position, size in lines, hash in two halves) of its windows: all of width lines, and with passage those of fewer lines and over so many words, or all lines of a shorter text."""

    def run(texts: pa.Array) -> pa.Array:
        at, out, places, sizes = [0], bytearray(), [], []
        for t in texts:
            found = worded(t.as_py() or "")
            lines = [xxhash.xxh3_128_digest(x.rstrip(" \t\r").encode()) for x in found]
            spans = [(k, width) for k in range(len(lines) - width + 1)]
            if passage is not None:
                n = [len(x.encode().split()) for x in found]
                short = {(k, 1) for k in range(len(n)) if n[k] > passage}
                short |= {(k, 2) for k in range(len(n) - 1) if max(n[k : k + 2]) <= passage < n[k] + n[k + 1]}
                if 0 < len(n) < width:
                    short.add((0, len(n)))
                spans += sorted(x for x in short if x[1] < width)
            for k, size in spans:
                out += xxhash.xxh3_128_digest(b"".join(lines[k : k + size]))
                places.append(k), sizes.append(size)
            at.append(len(places))
        pair = np.frombuffer(bytes(out), dtype="<i8").reshape(-1, 2)
        values = pa.StructArray.from_arrays([pa.array(places, pa.int32()), pa.array(sizes, pa.int32()), pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["position", "size", "a", "b"])
        return pa.ListArray.from_arrays(pa.array(at, type=pa.int32()), values)

    return run


def without(texts: pa.Array, starts: pa.Array) -> pa.Array:
    """Text without the worded lines that the windows (position, size) cover, and how many those are."""
    out, gone = [], []
    for t, s in zip(texts.to_pylist(), starts.to_pylist(), strict=True):
        if not s:
            out.append(t), gone.append(0)
            continue
        covered = {k for x in s for k in range(x["position"], x["position"] + x["size"])}
        kept, n = [], 0
        for line in t.split("\n"):
            if line and not line.encode().isspace():
                n += 1
                if n - 1 in covered:
                    continue
            kept.append(line)
        out.append("\n".join(kept)), gone.append(len(covered))
    return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(gone, pa.int64())], names=["text", "removed"])


def windowed(df: DataFrame, width: int = WIDTH, passage: int | None = None) -> DataFrame:
    """doc_id, version (a hash of the text), position, size, a, b: the windows of every document, with the halves of their hash."""
    ship(df.sparkSession)
    hashed = F.arrow_udf(lean(windows(width, passage)), "array<struct<position:int,size:int,a:bigint,b:bigint>>")
    text = F.coalesce("text", F.lit(""))
    return df.select("doc_id", F.xxhash64(text).alias("version"), F.explode(hashed(text)).alias("w")).select("doc_id", "version", "w.*")


def repeats(rows: DataFrame) -> DataFrame:
    """doc_id, version and starts: position and size of windows that repeat an earlier one, of each document of windowed() rows that has any.  Reads rows twice."""
    here = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("version"), F.col("position"))
    # only windows found more than once go on
    first = rows.groupBy("size", "a", "b").agg(F.min(here).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = rows.join(first, ["size", "a", "b"]).filter(here > F.col("first"))
    return again.groupBy("doc_id", "version").agg(F.collect_set(F.struct("position", "size")).alias("starts"))


def deduplicated(df: DataFrame, width: int = WIDTH, passage: int | None = None, counted: str = "removed") -> DataFrame:
    """The rows of df (doc_id, text and any others) with repeated lines removed from text, and their number in a last column named by counted, with _ added while df has a column of that name.

    Few texts change as a rule: rows that surely have no repeats pass without a shuffle."""
    while counted in df.columns:
        counted += "_"
    key = lambda i, v: F.xxhash64(F.coalesce(F.col(i), F.lit(-1)), v)
    # windows are more rows than texts have: executors keep them as blocks on their own disks until repeats are found, and make lost ones anew.
    # In a checkpoint each would be a row object and each task files, for which Hadoop starts programs beside the executor's heap
    rows = windowed(df, width, passage).persist(StorageLevel.DISK_ONLY)
    try:
        found = settled(repeats(rows).select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), F.col("starts").alias("__starts"), key("doc_id", "version").alias("__found")))
    finally:
        rows.unpersist()
    rows = df.select(packed(df), F.col("doc_id").alias("__of"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__v"))
    some, rest = parted(rows.withColumn("__key", key("__of", "__v")), "__key", found, "__found")
    some = some.join(found, F.col("__of").eqNullSafe(F.col("__id")) & (F.col("__v") == F.col("__version")), "left")
    cut = F.arrow_udf(lean(without), "struct<text:string,removed:bigint>")
    some = some.select(ROW, cut(F.col(f"{ROW}.text"), F.col("__starts")).alias("__cut")).select(ROW, F.col("__cut.text").alias("__text"), F.col("__cut.removed").alias("__n"))
    rows = some.union(rest.select(ROW, F.col(f"{ROW}.text").alias("__text"), F.lit(0).cast("long").alias("__n")))
    return rows.select(*[(F.col("__text") if c == "text" else F.col(f"{ROW}.`{c}`")).alias(c) for c in df.columns], F.col("__n").alias(counted))
