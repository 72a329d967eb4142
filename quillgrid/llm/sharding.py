"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table.  Shards take turns: each claims
the first slot of its permutation that is still free, until the table is full.  A key's hash names its
slot and so its shard: one lookup, even shares, and few moves when a shard joins or leaves.

Edge cases: rows with a null key are placed by a hash of their text, so that many of them spread over all
shards; rows with null key and text go to one slot; equal keys (repeated rows, ties) always share a shard; an
empty table gives no rows; only the named columns are read unless carry asks for the rest.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest table that is broadcast: 4 bytes a slot.
MOST_SLOTS = 2_000_003


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def number(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def lookup(shards: list[str], slots: int) -> np.ndarray:
    """For each slot the place in shards of the shard that claims it."""
    if not is_prime(slots) or not 0 < len(set(shards)) == len(shards) <= slots <= MOST_SLOTS:
        raise ValueError(f"slots must be a prime of at most {MOST_SLOTS} and no less than the number of different shards")
    start = [number(s, "start") % slots for s in shards]
    step = [number(s, "step") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    table, at, left = np.full(slots, -1, dtype=np.int32), [0] * len(shards), slots
    while left:
        for k in range(len(shards)):
            while table[slot := (start[k] + at[k] * step[k]) % slots] >= 0:
                at[k] += 1
            table[slot] = k
            at[k] += 1
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, text: Column, slots: int) -> Column:
    """The slot of a key: 60 bits of its md5, modulo the table's size."""
    named = F.when(key.isNotNull(), F.concat(F.lit("k"), key.cast("string"))).otherwise(F.concat(F.lit("t"), F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long") % slots).cast("long")


def table(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    """slot, shard: the lookup table as rows."""
    owner = lookup(shards, slots)
    return spark.createDataFrame(list(zip(range(slots), [shards[k] for k in owner.tolist()], strict=True)), "slot long, shard string")


def sharded(df: DataFrame, shards: list[str], slots: int = 65_537, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns of carry, slot and shard of every row; the table of slots rows, bounded by MOST_SLOTS, is broadcast."""
    spark = df.sparkSession
    rows = df.select(key, *carry, slot_of(F.col(key), F.col(text), slots).alias("slot"))
    return rows.join(F.broadcast(table(spark, shards, slots)), "slot").select(key, *carry, "slot", "shard")
