"""Text-quality analytics as Spark queries."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


#: Rows and bytes of an Arrow batch, where the session has Spark's own numbers: long texts make large batches, of which a worker holds several copies.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1024"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


def ship(spark: SparkSession) -> SparkSession:
    """Hands this package to the executors, once for each Spark context, so that their Python workers can import it wherever it lies on the driver."""
    sc = spark.sparkContext
    for key, (own, ours) in BATCH.items():
        if spark.conf.get(key, own) == own:
            spark.conf.set(key, ours)
    # a union that claims its children's partitioning fails when adaptive execution has merged one child's partitions and not another's
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    if not getattr(sc, "_quillgrid_shipped", False):
        top = os.path.dirname(os.path.abspath(__file__))
        with tempfile.NamedTemporaryFile(prefix="quillgrid-", suffix=".zip", delete=False) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.join("quillgrid", os.path.relpath(path, top)))
        sc.addPyFile(out.name)
        atexit.register(lambda: os.path.exists(out.name) and os.unlink(out.name))  # executors may fetch it as long as the driver lives
        sc._quillgrid_shipped = True
    return spark
