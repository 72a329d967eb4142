"""Sessions, and results that are read more than once."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def session(cores: int | str = "*", partitions: int = 8, **more: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    b = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    for key, value in more.items():
        b = b.config(key, value)
    return b.getOrCreate()


def settled(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder that the cluster names, so that what follows neither computes it again nor loses it with an executor.  Alone in this process, a temporary folder does."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillgrid-checkpoint-"))
    # as one struct, so that the result claims no partitioning, which adaptive execution may have changed since the plan was made
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    return df.select(row).checkpoint(eager=True).select("row.*")


def accumulated(df: DataFrame, keys: list[Column], **sums: Column) -> DataFrame:
    """df with a column for each of sums: the sum of its expression over all rows before in the order of keys (ascending, nulls first; keys should make rows distinct).

    Rows are dealt out by ranges of the keys, so no task sees more than one range; only a row for each range is summed up alone."""
    row, k, v = "__row", [f"__k{i}" for i in range(len(keys))], [f"__v{i}" for i in range(len(sums))]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(row), *[x.alias(n) for x, n in zip(keys, k, strict=True)], *[x.alias(n) for x, n in zip(sums.values(), v, strict=True)])
    rows = settled(rows.repartitionByRange(*k).sortWithinPartitions(*k).withColumn("__at", F.monotonically_increasing_id())).withColumn("__range", F.shiftright("__at", 33))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy("__range").agg(*[F.sum(n).alias(n) for n in v])
    heads = heads.select(F.col("__range").alias("__r"), *[F.sum(n).over(before).alias(f"{n}b") for n in v])
    inside = Window.partitionBy("__range").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(row, "__range", *[F.sum(n).over(inside).alias(n) for n in v]).join(F.broadcast(heads), F.col("__range") == F.col("__r"))
    zero = F.lit(0)
    return rows.select(*[F.col(f"{row}.`{c}`").alias(c) for c in df.columns if c not in sums], *[(F.coalesce(n, zero) + F.coalesce(f"{n}b", zero)).alias(c) for c, n in zip(sums, v, strict=True)])


#: Input of a task of costly work on each row, about; Spark's guess of it, which counts a few bytes for a text that is computed.
PIECE = 4 << 20
#: Guesses beyond are none: Spark has no size of an RDD or checkpoint, and multiplies the sides of a join.
UNKNOWN = 1 << 40


def spread(df: DataFrame) -> DataFrame:
    """df in tasks of about PIECE, four for each core at least: as its files lie, one row group would be one task, however many rows it has, and a file or two would keep only a few cores busy.

    Rows are dealt by their hash, so they are neither sorted before nor dealt otherwise when a task runs again."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    pieces = -(-size // PIECE) if size < UNKNOWN else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(4 * cores, pieces), *[F.col(f"`{c}`") for c in df.columns])
