"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard checks.

One permutation scatters shingles over a circle; a second one, shifted by k places, gives coordinate k of
the signature.  As all shifts of one shingle are a contiguous run of the second permutation, a signature is
the elementwise minimum of such runs.  Equal bands make candidates; candidates that hang together form a
cluster, and within clusters links are decided on the full sets:

1. in blocks of a cluster, all pairs, by products of document x shingle matrices (exact counts);
2. between the first block and the others;
3. in buckets that still hold more than one component, between the documents outside the bucket's largest one
   and all of the bucket's.

Documents of a bucket that are never compared are connected already, so components are those of all links that a
bucket holds.  Work grows with the square of a bucket only where its documents, equal in seven coordinates, are
not linked after all.

Edge cases: null and wordless texts have no shingles and link with nothing; a text of fewer words than a
shingle is one shingle; equal word sequences are one class, so copies cost nothing; a null doc_id links
with nothing and is kept; rows that repeat a doc_id are one document, whose links are those of the row with the least
hash of its words; texts of more shingles than the circle has places have like signatures, and are candidates of each
other; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid import ship
from quillgrid.llm.common import MIX, hashes, lean, parted, settled, shingle_hashes, sieved
from quillgrid.llm.components import components, joined

#: Places of the circle, bands, and coordinates of a band: of pairs of similarity 0.8 one in 12,000 shares no band, of 0.85 one in a million; of 0.5 every fourth does, of 0.3 one in 115.
PLACES, BANDS, ROWS = 1 << 20, 40, 7
WIDTH = 5
BLOCK, BIN = 256, 200
SKETCH = "struct<key:binary,n_shingles:bigint,bands:array<bigint>>"


def circle() -> np.ndarray:
    """The second permutation, with its start repeated at its end."""
    p = np.random.default_rng(20240607).permutation(PLACES).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([p, p[: BANDS * ROWS]]), BANDS * ROWS)


_circle: list[np.ndarray] = []


def signature(shingles: np.ndarray) -> np.ndarray:
    """BANDS x ROWS coordinates of a set of shingle hashes."""
    if not _circle:
        _circle.append(circle())
    places = ((shingles * MIX) >> np.uint64(44)).astype(np.int64)
    out = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, dtype=np.uint32)
    for k in range(0, len(places), 512):
        np.minimum(out, _circle[0][places[k : k + 512]].min(axis=0), out=out)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX
    for column in sig.reshape(BANDS, ROWS).T.astype(np.uint64):
        out = (out ^ column) * MIX
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def lowered(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def shingles(w: list[bytes], width: int) -> np.ndarray:
    return np.unique(shingle_hashes(hashes(w), width))


def sketch(width: int):
    def run(texts: pa.Array) -> pa.Array:
        keys, sizes, rows = [], [], []
        for t in texts:
            w = lowered(t.as_py())
            if not w:
                keys.append(None), sizes.append(0), rows.append(None)
                continue
            s = shingles(w, width)
            keys.append(xxhash.xxh3_128_digest(b" ".join(w))), sizes.append(len(s)), rows.append(bands(signature(s)))
        return pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], names=["key", "n_shingles", "bands"])

    return run


def keyed(texts: pa.Array) -> pa.Array:
    """The hash of each text's words."""
    return pa.array([xxhash.xxh3_128_digest(b" ".join(lowered(t.as_py()))) for t in texts], pa.binary())


def links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Pairs (i, j) with 100 x intersection >= percent x union of sets of left and right (None: of left, i < j); j counts on from left."""
    sets = left + (right or [])
    lengths = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), lengths)
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n > 1
    number = np.cumsum(shared) - 1
    pick = shared[column]
    owner, column = owner[pick], number[column[pick]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    a = len(left)
    common = np.zeros((a, len(sets) if right is None else len(right)), dtype=np.float32)
    width = 8192
    cuts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for k in range(len(cuts) - 1):
        x = np.zeros((len(sets), width), dtype=np.float32)
        x[owner[cuts[k] : cuts[k + 1]], column[cuts[k] : cuts[k + 1]] - k * width] = 1
        common += x[:a] @ (x if right is None else x[a:]).T
    other = lengths if right is None else lengths[a:]
    common = common.astype(np.int64)
    i, j = np.nonzero(100 * common >= percent * (lengths[:a, None] + other[None, :] - common))
    if right is None:
        keep = i < j
        return list(zip(i[keep].tolist(), j[keep].tolist(), strict=True))
    return list(zip(i.tolist(), (j + a).tolist(), strict=True))


def within(percent: int, width: int):
    """For groups with columns part, side, id, text: of each part, links among side 0, or of side 0 with side 1 if there is one.  id, root (the least id reached) of all ids of side 0, and of those linked of side 1."""

    def run(table: pa.Table) -> pa.Table:
        parts: dict[int, dict[int, dict[int, np.ndarray]]] = {}
        columns = [table[c].to_pylist() for c in ("part", "side", "id")]
        for part, side, i, text in zip(*columns, table["text"], strict=True):
            parts.setdefault(part, {0: {}, 1: {}})[side][i] = shingles(lowered(text.as_py()), width)
        out: list[tuple[int, int]] = []
        for two in parts.values():
            ids = [*two[0], *two[1]]  # one that is on both sides links with itself
            if len(ids) < 2:
                continue
            root = joined(links(list(two[0].values()), list(two[1].values()) if two[1] else None, percent), len(ids))
            least: dict[int, int] = {}
            for k, r in enumerate(root):
                least[r] = min(least.get(r, ids[k]), ids[k])
            out += [(ids[k], least[r]) for k, r in enumerate(root) if least[r] != ids[k]]
        return pa.table({"u": pa.array([x for x, _ in out], pa.int64()), "v": pa.array([y for _, y in out], pa.int64())})

    return run


def near_duplicates(df: DataFrame, percent: int = 85, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of df (doc_id, text)."""
    ship(df.sparkSession)
    found = F.arrow_udf(lean(sketch(width)), SKETCH)
    rows = settled(df.select("doc_id", found("text").alias("s")).select("doc_id", "s.*"))
    linkable = rows.filter("doc_id IS NOT NULL AND key IS NOT NULL")
    # of rows that repeat a doc_id one speaks for it; of documents of equal words the least doc_id
    repeated = settled(linkable.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("again")))
    repeats = not repeated.isEmpty()
    speaks = linkable.groupBy("doc_id").agg(F.min("key").alias("key")) if repeats else linkable.select("doc_id", "key")
    classes = speaks.groupBy("key").agg(F.min("doc_id").alias("id"))
    heads = settled(linkable.join(classes, [linkable["key"] == classes["key"], linkable["doc_id"] == classes["id"]], "left_semi").select(F.col("doc_id").alias("id"), "key", "bands").dropDuplicates(["id"]))

    # candidates: all documents of a bucket hang on its least one
    spread = heads.select("id", F.explode("bands").alias("band"))
    buckets = spread.groupBy("band").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1").select("band", "least")
    candidates = spread.join(buckets, "band").filter("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v"))
    clusters = settled(components(candidates).select(F.col("node").alias("id"), F.col("component").alias("cluster")))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("m"))
    blocks = F.ceil(F.col("m") / block)
    members = settled(clusters.join(sizes, "cluster").select("id", "cluster", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).alias("block")))
    texts = df.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    if repeats:
        some, others = parted(texts, "id", repeated, "again")
        key = F.arrow_udf(lean(keyed), "binary")
        some = some.withColumn("key", key("text")).join(heads.select("id", "key"), ["id", "key"], "left_semi").dropDuplicates(["id"]).select("id", "text")
        texts = some.union(others)
    compare = "u long, v long"

    # 1. whole clusters by the bin, or blocks of large ones
    bins = max(1, members.count() // BIN)
    one = members.select("id", F.xxhash64("cluster", "block").alias("part"), F.lit(0).alias("side"), F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(bins))).otherwise(F.xxhash64("cluster", "block")).alias("bin"))
    run = lean(within(percent, width))
    first = settled(sieved(texts, "id", members, "id").join(one, "id").groupBy("bin").applyInArrow(run, compare))
    edges = first
    large = members.filter("blocks > 1")
    if not large.isEmpty():
        held = settled(sieved(texts, "id", large, "id").join(large, "id"))
        # 2. the first block with each other one
        lead = held.filter("block = 0").withColumn("other", F.explode(F.sequence(F.lit(1).cast("long"), F.col("blocks") - 1)))
        two = lead.select("id", "text", F.lit(0).alias("side"), F.xxhash64("cluster", "other").alias("part"))
        two = two.union(held.filter("block > 0").select("id", "text", F.lit(1), F.xxhash64("cluster", "block")))
        edges = settled(edges.union(two.groupBy("part").applyInArrow(run, compare)))
        # 3. buckets with more than one component: what is outside the largest with all of the bucket
        now = components(edges.filter("u IS NOT NULL")).withColumnRenamed("node", "id")
        placed = settled(large.select("id").join(now, "id", "left").select("id", F.coalesce("component", "id").alias("component")))
        there = heads.join(placed, "id").select("id", "component", F.explode("bands").alias("band"))
        mixed = there.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n")).filter("a <> b").select("band", "n")
        there = settled(there.join(mixed, "band"))
        if not there.isEmpty():
            counts = there.groupBy("band", "component").agg(F.count("*").alias("m"))
            largest = counts.groupBy("band").agg(F.max(F.struct("m", "component"))["component"].alias("largest"), F.max("m").alias("m"))
            there = there.join(largest, "band").withColumns({"blocks": F.ceil(F.col("n") / block), "strips": F.ceil((F.col("n") - F.col("m")) / block), "outside": F.col("component") != F.col("largest")})
            part = F.xxhash64("band", "strip", "block")
            out = there.filter("outside").withColumn("strip", F.pmod(F.xxhash64(F.lit("strip"), "id"), F.col("strips"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            all_ = there.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("strip", F.explode(F.sequence(F.lit(0).cast("long"), F.col("strips") - 1)))
            sides = out.select("id", F.lit(0).alias("side"), part.alias("part")).union(all_.select("id", F.lit(1), part))
            # buckets of the same two sides are compared once
            same = settled(sides.groupBy("part").agg(F.sum(F.xxhash64("id", "side").cast("decimal(38,0)")).alias("mark"), F.count("*").alias("k")))
            first_of = same.groupBy("mark", "k").agg(F.min("part").alias("part")).select("part")
            three = held.select("id", "text").join(sides.join(first_of, "part", "left_semi"), "id").select("id", "text", "side", "part")
            edges = settled(edges.union(three.groupBy("part").applyInArrow(run, compare)))

    reach = components(edges).select(F.col("node").alias("id"), "component")
    heads_of = classes.join(reach, "id", "left").select("key", F.coalesce("component", "id").alias("component_id"))
    if repeats:
        heads_of = heads_of.join(speaks, "key").select(F.col("doc_id").alias("of"), "component_id")
        good = linkable.join(heads_of, F.col("doc_id") == F.col("of")).select("doc_id", "n_shingles", "component_id")
    else:
        good = linkable.join(heads_of, "key").select("doc_id", "n_shingles", "component_id")
    rest = rows.filter("doc_id IS NULL OR key IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return good.unionByName(rest)
