"""Tables that change, as Parquet in a shared folder: each change writes the next version and lets the one before go.

A reader sees a whole version at any time; a job that dies leaves at most a version without its mark, which the next
change removes.  Folders are listed and removed through Spark's file systems, so any store will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VERSION = "v%08d"
MARK = "_SUCCESS"


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, folder: str) -> list[tuple[int, bool]]:
    """Number and wholeness of each version in a folder, in order."""
    fs, path = _files(spark, folder)
    if not fs.exists(path):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(path)]
    return sorted((int(n[1:]), fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/{MARK}"))) for n in names if n[:1] == "v" and n[1:].isdigit())


def stored(spark: SparkSession, folder: str) -> DataFrame | None:
    """The latest whole version; None if there is none."""
    whole = [n for n, ok in versions(spark, folder) if ok]
    return spark.read.parquet(f"{folder}/{VERSION % whole[-1]}") if whole else None


def overwritten(df: DataFrame, folder: str) -> DataFrame:
    """df as the next version (it may come from the present one); older ones go once it is whole."""
    spark = df.sparkSession
    known = versions(spark, folder)
    new = 1 + max((n for n, _ in known), default=0)
    df.write.mode("overwrite").parquet(f"{folder}/{VERSION % new}")
    for n, _ in known:
        fs, path = _files(spark, f"{folder}/{VERSION % n}")
        fs.delete(path, True)
    return spark.read.parquet(f"{folder}/{VERSION % new}")


def appended(df: DataFrame, folder: str) -> DataFrame:
    """The table with the rows of df, which are written beside its files; no row that is there is written again."""
    spark = df.sparkSession
    now = stored(spark, folder)
    if now is None:
        return overwritten(df, folder)
    last = [n for n, ok in versions(spark, folder) if ok][-1]
    df.select(*now.columns).write.mode("append").parquet(f"{folder}/{VERSION % last}")
    return stored(spark, folder)


def without_files(spark: SparkSession, folder: str, gone: DataFrame, column: str = "path") -> DataFrame | None:
    """The table without the rows of files (column) among gone."""
    now = stored(spark, folder)
    return now if now is None else overwritten(now.join(gone.select(column).distinct(), column, "left_anti").select(*now.columns), folder)
