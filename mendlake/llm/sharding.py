"""Sharding by a permutation-filled lookup table.

Every shard has a permutation of the slots of a prime-sized table, made from two hashes of its name. Shards take turns
(as often as their weight) and claim the first slot of their own order that is still free, until the table is full. A
record goes to the shard at slot hash(key) mod M. The table has M entries whatever the data hold, so it is a constant
of the plan: placement is one hash and one probe of a broadcast map a row, without any shuffle, and a hot source or
key spreads over all shards as its records have keys of their own. Adding or losing a shard moves few other slots.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendlake.llm.store import unused

#: Slots of the table; a prime, at least 100 a shard, which keeps shards within about one percent of each other.
SLOTS = 4093
HEX = 15  # leading hex digits of an MD5 that make a non-negative long


def _hash(text: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{text}".encode()).hexdigest()[:HEX], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(shards: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> list[int]:
    """Owner (position in shards) of each slot. weights: claims that a shard makes in each round, 1 by default."""
    if not shards or not is_prime(slots) or slots < len(shards):
        raise ValueError("needs shards, and a prime number of slots that is not below their number")
    if len(set(shards)) < len(shards):
        raise ValueError("shard names repeat")
    weights = weights or [1] * len(shards)
    if len(weights) != len(shards) or min(weights) < 0 or not any(weights):
        raise ValueError("weights: one for each shard, not negative, not all zero")
    start = [_hash(s, "offset") % slots for s in shards]
    step = [_hash(s, "skip") % (slots - 1) + 1 for s in shards]
    turn, owner, free = [0] * len(shards), [-1] * slots, slots
    while free:
        for i, weight in enumerate(weights):
            for _ in range(min(weight, free)):
                while owner[slot := (start[i] + turn[i] * step[i]) % slots] >= 0:
                    turn[i] += 1
                owner[slot] = i
                free -= 1
    return owner


def slot_of(key: Column, slots: int = SLOTS, seed: int = 0) -> Column:
    """Slot of a key; null keys take the slot of the empty string."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, HEX), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS, seed: int = 0, weights: list[int] | None = None) -> DataFrame:
    """df with the columns slot (int), shard (int) and shard_name.

    Columns of df that have such a name (in any case of letters) stay, and the new one gets underscores in front. Nulls:
    a null key is placed like an empty one. Repeated rows go to the same shard. An empty df gives an empty result.
    Order and number of rows stay.
    """
    spark = df.sparkSession
    owner = fill(shards, slots, weights)
    text = ",".join(map(str, owner))
    names = F.array(*[F.lit(s) for s in shards])
    lookup = spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("slot", "shard"))
    lookup = lookup.select("slot", F.col("shard").cast("int").alias("shard"))
    slot, number, name = (unused(df, c) for c in ("slot", "shard", "shard_name"))
    lookup = lookup.select(F.col("slot").alias(slot), F.col("shard").alias(number), F.get(names, F.col("shard")).alias(name))
    placed = df.withColumn(slot, slot_of(F.col(f"`{key}`"), slots, seed)).join(F.broadcast(lookup), slot, "left")
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], slot, number, name)
