"""Connected components of a graph given as edges, by alternating star contractions.

Each round links every node's larger neighbours to its least one and then its smaller ones likewise; after
a few rounds (about the logarithm of the longest path) every node hangs on the least node of its component.
Minima are summed up before they are shuffled, and joins by node are ones whose skewed keys Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import settled

#: So many edges fit one task with room to spare, which then finishes alone; more take further rounds.
FEW = 250_000


def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, component of the edges of all batches, at most FEW."""
    parts = [np.stack([np.asarray(b.column(0)), np.asarray(b.column(1))]) for b in batches if b.num_rows]
    if parts:
        nodes, at = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
        u, v = at.reshape(2, -1).tolist()
        root = joined(list(zip(u, v, strict=True)), len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of every node on an edge (u, v) that is not a loop or null."""
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = settled(now)
    mark = _mark(now)
    while mark[0]:
        if mark[0] <= FEW:
            return settled(now.coalesce(1).mapInArrow(finished, "node long, component long"))
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(lower, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = settled(lower.select("u", F.col("m").alias("v")).union(rest).distinct())
        was, mark, now = mark, _mark(after), after
        if was == mark:
            break
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def joined(pairs: list[tuple[int, int]], n: int) -> list[int]:
    """The least number reachable from each of 0 .. n-1 by pairs."""
    parent = list(range(n))
    for a, b in pairs:
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b:
            parent[max(a, b)] = min(a, b)
    for k in range(n):
        parent[k] = parent[parent[k]]
    return parent
