"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size. The shards take
turns; in a turn a shard claims the first slot of its order that is still free. All shards end with
nearly the same number of slots, and taking one shard away moves few rows of the others. The table has
``size`` rows whatever the data, so it is broadcast, and placement is one hash and one lookup.

Defined cases: a null key has a slot like any other value; equal keys share a slot; an empty table gives
an empty result; columns of the input stay as they are, and an output name that the input already has
is refused.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailsift.operators.skew import hot_keys

#: Slots of the table; a prime, so that every step walks through all slots.
SIZE = 65537


def _number(name: str, use: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{use}|{name}".encode()).digest()[:8], "big")


def lookup_table(shards: list[str], size: int = SIZE) -> list[int]:
    """For each slot, the position in ``shards`` of its owner. ``size`` must be a prime above the shard count."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if size <= len(shards) or any(size % d == 0 for d in range(2, int(size ** 0.5) + 1)):
        raise ValueError("size must be a prime above the number of shards")
    at = [_number(s, "offset") % size for s in shards]
    step = [_number(s, "skip") % (size - 1) + 1 for s in shards]
    owner = [-1] * size
    free = size
    while free:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            owner[at[i]] = i
            free -= 1
            if not free:
                break
    return owner


def table_frame(spark: SparkSession, shards: list[str], size: int = SIZE, out: str = "shard") -> DataFrame:
    """(slot, shard) rows of the lookup table, made in the JVM from one literal."""
    owners = ",".join(map(str, lookup_table(shards, size)))
    names = F.array(*[F.lit(s) for s in shards])
    filled = spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("_slot", "_owner"))
    return filled.select("_slot", F.get(names, F.col("_owner").cast("int")).alias(out))


def slot_of(size: int, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(size)).cast("int")


def place(df: DataFrame, key: list[str], shards: list[str], size: int = SIZE, out: str = "shard") -> DataFrame:
    """``df`` with the shard of each row by its key."""
    if out in df.columns or "_slot" in df.columns:
        raise ValueError(f"the input already has a column {out} or _slot")
    slots = table_frame(df.sparkSession, shards, size, out)
    rows = df.withColumn("_slot", slot_of(size, *[F.col(f"`{k}`") for k in key]))
    return rows.join(F.broadcast(slots), "_slot", "left").drop("_slot")


def place_groups(df: DataFrame, group: str, row: str, shards: list[str], size: int = SIZE,
                 out: str = "shard") -> DataFrame:
    """Rows of a group share a shard, but a hot group is dealt out over all shards by its row key.

    Hot means more than one row in a thousand of the table, so the hot list has a thousand keys at most
    and is broadcast.
    """
    if out in df.columns:
        raise ValueError(f"the input already has a column {out}")
    counts = df.groupBy(F.col(f"`{group}`").alias("_group")).agg(F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(hot_keys(counts, "_group").withColumn("_hot", F.lit(True)))
    held = df.select(F.col(f"`{group}`").alias("_own"), F.col(f"`{row}`").alias("_key"),
                     F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    marked = held.join(hot, F.col("_own").eqNullSafe(F.col("_group")), "left")
    slots = table_frame(df.sparkSession, shards, size, "_shard")
    slot = F.when(F.col("_hot"), slot_of(size, F.col("_own"), F.col("_key"))).otherwise(slot_of(size, F.col("_own")))
    rows = marked.select(slot.alias("_slot"), "_row")
    return rows.join(F.broadcast(slots), "_slot", "left").select("_row.*", F.col("_shard").alias(out))
