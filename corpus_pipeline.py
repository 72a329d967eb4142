"""The corpus pipeline: documents of good quality, without repeated lines and near copies, mixed and encoded.

Edge cases, in all stages: null and empty texts are scored like other texts, keep their lines, are nobody's near copy and
have no words to mix, so they go at mixing; documents without a doc_id are scored, come last among repeats of lines, are
nobody's near copy and are mixed like others; of rows that repeat a doc_id one goes on from near-dedup; very long texts
count by their words; an empty table passes through all stages as one; further columns keep their values, whatever
their names, up to encoding, which returns its own.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid import ship
from quillgrid.llm import bpe, fmquality, linededup, minhash, mix
from quillgrid.llm.common import ROW, packed, parted, ready, settled, unpacked
from quillgrid.llm.queries import MOST, PASS, SHARE, WEIGHTS

#: Percent of five-word shingles that near copies share (op6_minhash has a bound of its own).
PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least PASS; learned from the labelled ones among docs."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return docs.filter(fmquality.scored(docs, fmquality.learned(docs, labels)) >= PASS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of windows, or of passages of over 50 words, that an earlier one holds; one that loses all its words goes."""
    ship(spark)
    n = "__removed"
    out = linededup.deduplicated(docs, passage=linededup.PASSAGE, counted=n).filter(~((F.col(n) > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(n) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the least doc_id; of rows that repeat its doc_id, the one of the least hash of its text."""
    ship(spark)
    found = settled(minhash.near_duplicates(docs, PERCENT))
    kept = docs.join(found.filter("doc_id <> component_id").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    again = settled(found.groupBy("doc_id").count().filter("doc_id IS NOT NULL AND count > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    some, rest = parted(kept.select(packed(kept), F.col("doc_id").alias("__id")), "__id", again, "doc_id")
    one = some.filter("__id IS NOT NULL").groupBy("__id").agg(F.min_by(ROW, F.xxhash64(f"{ROW}.text")).alias(ROW))
    return unpacked(one.select(ROW).union(some.filter("__id IS NULL").select(ROW)).union(rest.select(ROW)))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix of sources takes them, in the order of its schedule."""
    ship(spark)
    return mix.repeated(docs, WEIGHTS, SHARE, MOST)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their digest, and that of the bytes they decode to."""
    ship(spark)
    encode, _, digest = bpe.udfs(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return docs.select("doc_id", "source", digest(encode(F.coalesce("text", F.lit("")))).alias("d")).select("doc_id", "source", "d.*")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again, and goes when the next stage's is written."""
    ready(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        docs, before = spark.read.parquet(out), out
    return docs
