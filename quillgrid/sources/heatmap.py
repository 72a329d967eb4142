"""Attention matrices as archives that viewers read: one gzipped tar with one JSON file for each scan."""

from __future__ import annotations

import gzip
import io
import json
import tarfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid import ship


def packed(name: str, body: str) -> bytes:
    """A gzipped tar of one file; equal contents give equal bytes."""
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", mtime=0) as zipped, tarfile.open(fileobj=zipped, mode="w", format=tarfile.USTAR_FORMAT) as tar:
        data = body.encode()
        entry = tarfile.TarInfo(name)
        entry.size = len(data)
        tar.addfile(entry, io.BytesIO(data))
    return out.getvalue()


def archives(attention: DataFrame, queries: DataFrame, context: DataFrame) -> DataFrame:
    """scan, archive (binary) of attention (scan, q, c, score) with the texts of its queries (scan, q, text) and context (scan, c, text)."""
    ship(attention.sparkSession)
    cells = attention.groupBy("scan").agg(F.sort_array(F.collect_list(F.struct("q", "c", "score"))).alias("cells"))
    side = lambda df, key, name: df.groupBy("scan").agg(F.sort_array(F.collect_list(F.struct(key, "text"))).alias(name))
    rows = cells.join(side(queries, "q", "queries"), "scan", "left").join(side(context, "c", "context"), "scan", "left")
    body = F.to_json(F.struct(F.col("scan").cast("string").alias("scan"), "queries", "context", "cells"))

    @F.arrow_udf("binary")
    def run(scans: pa.Array, bodies: pa.Array) -> pa.Array:
        return pa.array([packed("heatmap.json", b) for _, b in zip(scans.to_pylist(), bodies.to_pylist(), strict=True)], pa.binary())

    return rows.select("scan", run(F.col("scan").cast("string"), body).alias("archive"))


def unpacked(archive: bytes) -> dict:
    with tarfile.open(fileobj=io.BytesIO(archive), mode="r:gz") as tar:
        return json.load(tar.extractfile(tar.getmembers()[0]))
