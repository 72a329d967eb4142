"""Near-duplicates among embeddings by int8 tile products with error bounds.

Vectors of one label are cut into blocks, and pairs of blocks into tiles.  In a tile every vector is
quantised to int8; the integer products are exact, and the norm of each vector's own quantisation error
bounds how far a product can be from the true cosine.  Only pairs that the bound leaves possibly at or above the threshold
are computed again in double precision.  A tile returns a row for each vector: its links and the least
vector that it reaches, never pairs.

Equal vectors are one class with a count, so copies cost nothing.  There are more pivots as there are more blocks (by
their root where they are many, within bounds); a cell holds the vectors nearest to one, and its blocks lie one after the other by angle
to it.  A pair of cells, and then of blocks, is left out if their ranges of angles to some pivot are further
apart than the threshold's angle: by the triangle inequality no link can be lost.  Where vectors don't
cluster, all pairs of blocks of a label are computed.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite values, and rows with a null
label or vec_id link with nothing; vectors of different lengths don't link; repeated rows count as
other vectors; ties at the threshold link; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrid import ship
from quillgrid.llm.common import lean, settled, small
from quillgrid.llm.components import components, joined

BLOCK = 4096
#: Pivots: as many as blocks, and of many blocks 16 times their root; at least and at most so many (those of the least hashes: a bounded sample).
LEAST_PIVOTS, MOST_PIVOTS = 8, 512
SLICE = 1024
#: Steps of angle by which a cell's vectors are put in order.
STEPS = 1024


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows in double precision, of length 1."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def quantised(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales and the norm of each row's quantisation error."""
    scale = np.abs(rows).max(axis=1) / 127
    q = np.rint(rows / scale[:, None]).astype(np.int8)
    error = rows - q * scale[:, None]
    return q, scale, np.sqrt(np.einsum("ij,ij->i", error, error)) + 1e-12


def linked(a: np.ndarray, b: np.ndarray | None, threshold: float):
    """Yields arrays of the pairs (i, j) of unit rows of a and b (None: of a, i < j) with a product of at least threshold, tile by tile.

    |x.y - s t q.r| <= |e||y| + |s q||f| <= e + (1 + e) f for errors e, f of x = s q + e and y = t r + f.  Products of
    int8 values are summed in float32, which is exact below 2^24: up to 1040 dimensions at once."""
    qa, sa, ea = quantised(a)
    qb, sb, eb = (qa, sa, ea) if b is None else quantised(b)
    other = a if b is None else b
    width = 1040
    for i in range(0, len(a), SLICE):
        for j in range(i if b is None else 0, len(other), SLICE):
            x, y = slice(i, i + SLICE), slice(j, j + SLICE)
            product = np.zeros((len(qa[x]), len(qb[y])), dtype=np.float32 if a.shape[1] <= width else np.float64)
            for d in range(0, a.shape[1], width):
                product += qa[x, d : d + width].astype(np.float32) @ qb[y, d : d + width].astype(np.float32).T
            # with the tile's largest scale and error on one side, a bound for each row
            worst = eb[y].max()
            least = (threshold - ea[x] - (1 + ea[x]) * worst) / (sa[x] * sb[y].max())
            if least.min() <= 0:
                least = np.where(least > 0, least, -np.inf)
            r, c = np.nonzero(product >= (least * (1 - 1e-6))[:, None])
            bound = ea[x][r] + (1 + ea[x][r]) * eb[y][c]
            near = product[r, c] * (sa[x][r] * sb[y][c]) + bound + 1e-9 >= threshold
            r, c = r[near] + i, c[near] + j
            if b is None:
                r, c = r[r < c], c[r < c]
            for k in range(0, len(r), 1 << 16):
                rk, ck = r[k : k + (1 << 16)], c[k : k + (1 << 16)]
                true = np.einsum("ij,ij->i", a[rk], other[ck]) >= threshold
                if true.any():
                    yield rk[true], ck[true]


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(len(column), -1)


def tile(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """Links of the rows of one tile: side 0 with side 1, or side 0 with itself."""
        table = table.combine_chunks()
        side = np.asarray(table["side"])
        order = np.argsort(side, kind="stable")
        ids, copies, rows = np.asarray(table["id"])[order], np.asarray(table["copies"])[order], unit(matrix(table["embedding"]))[order]
        n = int((side == 0).sum())
        alone = bool(np.asarray(table["alone"])[0])
        a, b = rows[:n], None if alone else rows[n:]
        links, pairs = np.zeros(len(ids), dtype=np.int64), []
        if n and (alone or len(rows) > n):
            group = np.arange(len(ids))
            for i, j in linked(a, b, threshold):
                j = j if alone else j + n
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                open_ = group[i] != group[j]
                pairs += zip(i[open_].tolist(), j[open_].tolist(), strict=True)
                if len(pairs) > 100_000:
                    group = np.array(joined(pairs, len(ids)))
                    pairs = list(zip(range(len(ids)), group.tolist(), strict=True))
        root = np.array(joined(pairs, len(ids)), dtype=np.int64)
        least = ids.copy()
        np.minimum.at(least, root, ids)
        kept = links > 0
        return pa.table({"id": ids[kept], "links": links[kept], "root": least[root][kept]})

    return run


def angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit(rows) @ pivots.T, -1, 1))


def homes(pivots: np.ndarray):
    """Of each vector the cell (the nearest of the first cells pivots) and its angle to it; vectors of another length than the pivots have cell 0 and angle 0."""

    def run(vectors: pa.Array, cells: pa.Array) -> pa.Array:
        lengths, n = np.diff(np.asarray(vectors.offsets)), np.asarray(cells)
        cell, angle = np.zeros(len(vectors), dtype=np.int32), np.zeros(len(vectors))
        same = np.nonzero((lengths == pivots.shape[1]) & (len(pivots) > 0))[0]
        for k in range(0, len(same), SLICE):
            at = same[k : k + SLICE]
            got = angles(np.asarray(vectors.take(pa.array(at)).flatten()).reshape(len(at), -1), pivots)
            got[np.arange(len(pivots))[None, :] >= n[at][:, None]] = np.inf
            cell[at] = got.argmin(axis=1)
            angle[at] = got[np.arange(len(at)), cell[at]]
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(angle)], names=["cell", "angle"])

    return run


def ranges(pivots: np.ndarray):
    """Of the vectors of one block: the least and the greatest angle to each pivot (to all of them, where lengths differ)."""

    def run(table: pa.Table) -> pa.Table:
        rows = matrix(table["embedding"])
        low, high = np.zeros(len(pivots)), np.full(len(pivots), math.pi)
        if rows.shape[1] == pivots.shape[1]:
            low[:], high[:] = math.pi, 0
            for k in range(0, len(rows), SLICE):
                got = angles(rows[k : k + SLICE], pivots)
                low, high = np.minimum(low, got.min(axis=0)), np.maximum(high, got.max(axis=0))
        one = {c: table[c][0].as_py() for c in ("label", "dim", "cell", "block")}
        return pa.Table.from_pylist([one | {"low": low.tolist(), "high": high.tolist()}], pa.schema([("label", table.schema.field("label").type), ("dim", pa.int32()), ("cell", pa.int32()), ("block", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]))

    return run


def tiled(classes: DataFrame, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(tiles, classes): the pairs of blocks (block, block_, tile, alone) that can hold a link, and classes (label, dim, id, h, embedding ...) with their block."""
    sizes = settled(classes.groupBy("label", "dim").agg(F.count("*").alias("n")))
    blocks_of_all = (sizes.agg(F.sum("n")).first()[0] or 0) / block
    most = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, math.ceil(min(blocks_of_all, 16 * math.sqrt(blocks_of_all))))))
    chosen = [r["embedding"] for r in classes.orderBy(F.hash("h"), "h", "id").select("embedding").limit(most).collect()]
    dim = max(map(len, chosen), default=1)
    same = [p for p in chosen if len(p) == dim]
    pivots = unit(np.array(same, dtype=np.float64)) if same else np.zeros((0, 1))

    home = F.arrow_udf(lean(homes(pivots)), "struct<cell:int,angle:double>")
    cells = small(sizes.withColumn("cells", F.greatest(F.lit(1), F.least(F.lit(len(pivots)), F.floor(F.col("n") / block)).cast("int"))).drop("n"))
    known = classes.join(cells, ["label", "dim"]).withColumn("x", home("embedding", "cells"))
    keys = ["label", "dim", "cell", "step"]
    known = settled(known.select("id", "copies", "label", "dim", "embedding", "x.cell", F.least(F.lit(STEPS - 1), F.floor(F.col("x.angle") * (STEPS / math.pi))).cast("int").alias("step")))
    # a cell's vectors in order of their angle, cut where a block is full; a step of more vectors than that is cut by a hash
    before = Window.partitionBy("label", "dim", "cell").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    counts = known.groupBy(*keys).agg(F.count("*").alias("m"))
    counts = small(settled(counts.select(*keys, F.floor(F.coalesce(F.sum("m").over(before), F.lit(0)) / block).alias("part"), F.ceil(F.col("m") / block).alias("cuts"))))
    known = known.join(counts, keys).withColumn("block", F.xxhash64("label", "dim", "cell", "part", F.when(F.col("cuts") > 1, F.struct("step", F.pmod(F.xxhash64("id"), F.col("cuts"))))))
    known = settled(known.select("id", "copies", "label", "dim", "embedding", "cell", "block"))

    of_label = dict(known.dtypes)["label"]
    blocks = known.select("label", "dim", "cell", "block", "embedding").groupBy("block").applyInArrow(lean(ranges(pivots)), f"label {of_label}, dim int, cell int, block long, low array<double>, high array<double>")
    blocks = settled(blocks)
    apart = math.acos(min(1.0, max(-1.0, threshold))) + 1e-6
    near = lambda a, b: F.forall(F.zip_with(F.col(f"low{a}"), F.col(f"high{b}"), lambda x, y: x <= y + apart), lambda x: x)
    wide = blocks.groupBy("label", "dim", "cell").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs"))
    fold = lambda column, f: F.aggregate(F.slice(column, F.lit(2), F.size(column)), F.col(column)[0], lambda s, x: F.zip_with(s, x, f))
    wide = wide.select("label", "dim", "cell", fold("lows", lambda x, y: F.least(x, y)).alias("low"), fold("highs", lambda x, y: F.greatest(x, y)).alias("high"))
    other = lambda df: df.select("label", "dim", *[F.col(c).alias(f"{c}_") for c in df.columns if c not in ("label", "dim")])
    met = settled(wide.join(other(wide), ["label", "dim"]).filter((F.col("cell") <= F.col("cell_")) & near("", "_") & near("_", "")).select("label", "dim", "cell", "cell_"))
    tiles = blocks.join(met, ["label", "dim", "cell"]).join(other(blocks), ["label", "dim", "cell_"])
    tiles = tiles.filter(((F.col("cell") < F.col("cell_")) | (F.col("block") <= F.col("block_"))) & near("", "_") & near("_", ""))
    return settled(tiles.select("block", "block_", F.xxhash64("block", "block_").alias("tile"), (F.col("block") == F.col("block_")).alias("alone"))), known


def near_duplicates(df: DataFrame, threshold: float = 0.98, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id of every row of df (vec_id, embedding, label)."""
    spark = df.sparkSession
    ship(df.sparkSession)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = df.select("vec_id", "embedding", "label")
    fitting = rows.filter(fit).withColumn("h", F.xxhash64("embedding"))
    classes = fitting.groupBy("label", "h", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    classes = settled(classes.withColumn("dim", F.size("embedding")))

    tiles, known = tiled(classes, threshold, block)
    sides = tiles.select("tile", "alone", F.col("block"), F.lit(0).alias("side")).union(tiles.filter("not alone").select("tile", "alone", F.col("block_"), F.lit(1)))
    dealt = known.select("id", "copies", "embedding", "block").join(sides, "block").select("tile", "alone", "side", "id", "copies", "embedding")
    found = settled(dealt.groupBy("tile").applyInArrow(lean(tile(threshold)), "id long, links long, root long"))

    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    reach = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    of_class = classes.select("label", "h", "embedding", "id", "copies").join(links, "id", "left").join(reach.withColumnRenamed("node", "id"), "id", "left")
    of_class = of_class.select("label", "h", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    good = fitting.join(of_class, ["label", "h", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = rows.filter(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest)
