"""Row positions, caps, slices, shards and splits."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mendlake.tables import unused, written_once


#: Rows of a task of by_key().
ROWS_A_TASK = 500_000


def positions(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """df with each row's place (from 0) in a total order.

    A range-partitioned sort numbers rows within partitions; the partitions' sizes, summed up, shift them. The only
    window without a key is over one row a partition.
    """
    part, row, before, size = (unused(df, c) for c in ("_part", "_row", "_before", "_size"))
    place = F.monotonically_increasing_id()
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(row, place)
    cut = written_once(cut.withColumn(part, F.shiftright(row, 33)).withColumn(row, F.col(row).bitwiseAND(F.lit((1 << 33) - 1))), "positions")
    sizes = cut.groupBy(part).agg(F.count(F.lit(1)).alias(size))
    ahead = F.coalesce(F.sum(size).over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return cut.join(F.broadcast(sizes.select(part, ahead.alias(before))), part).withColumn(name, F.col(before) + F.col(row)).drop(part, row, before)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df with rows that are equal in some columns side by side, in tasks for every core however few bytes the rows
    have: for work on rows that is heavy for their size and that equal rows share."""
    spark = df.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *by).sortWithinPartitions(*by)


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """df with a key's rows in one task, in as many tasks as its rows (which are counted) call for, so that a task's
    memory doesn't grow with the table. Aggregations, windows and joins by the keys then need no other shuffle of it."""
    parts = max(-(-df.count() // ROWS_A_TASK), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys)


def sliced(df: DataFrame, start: int, end: int, n: int, pos: str = "pos") -> DataFrame:
    """Rows of [start, end); an end of 0 or less or beyond n is n."""
    end = n if end <= 0 or end > n else end
    return df.filter((F.col(pos) >= max(0, start)) & (F.col(pos) < end))


def shard(df: DataFrame, n_shards: int, index: int, pos: str = "pos") -> DataFrame:
    if not 0 <= index < n_shards:
        raise ValueError(f"shard {index} of {n_shards}")
    return df.filter(F.pmod(F.col(pos), F.lit(n_shards)) == index)


def capped(df: DataFrame, keys: list[str], cap: int, *order: str) -> DataFrame:
    """At most cap rows a key, the first in order (the cap is applied before the shuffle too)."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= cap).drop("_n")


def occurrence(keys: list[str], *order: str) -> Column:
    """How many rows of the key stand before this one. A key's rows meet in one task: see occurrences()."""
    return F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1


def occurrences(df: DataFrame, keys: list[str], *order: str, name: str = "occurrence") -> DataFrame:
    """df with how many rows of the key stand before each one, for keys of any size; null is a key like any other.

    A range-partitioned sort deals a key's rows to as many tasks as they fill; the place of its first row, one row a
    key, is taken off. Rows that are equal in keys and order are numbered in any order.
    """
    pos, first, there = unused(df, "_pos"), unused(df, "_first"), [unused(df, f"_key{i}") for i in range(len(keys))]
    placed = positions(df, *keys, *order, name=pos)
    firsts = placed.groupBy(*[F.col(k).alias(t) for k, t in zip(keys, there, strict=True)]).agg(F.min(pos).alias(first))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(t)) for k, t in zip(keys, there, strict=True)])
    return placed.join(firsts, same).withColumn(name, F.col(pos) - F.col(first)).drop(pos, first, *there)


def prompt_of(i: Column, per_prompt: Column, n_prompts: Column) -> Column:
    """The prompt that the i-th rollout of a batch belongs to."""
    return F.least(n_prompts - 1, F.floor(i / F.greatest(per_prompt, F.lit(1)))).cast("int")


def name_hash(name: Column) -> Column:
    """The first 32 bits of a name's MD5 as a number, for seeds."""
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long")


def shuffled_places(n: int, name: str, seed: int = 1012) -> np.ndarray:
    """Where each of a file's n rows stands in its seeded permutation; the first n // 2 are dev."""
    rng = np.random.RandomState((seed + int(hashlib.md5(name.encode()).hexdigest()[:8], 16)) % 2**32)
    order = np.arange(n)
    rng.shuffle(order)
    places = np.empty(n, np.int64)
    places[order] = np.arange(n)
    return places


def half_splits(files: DataFrame, seed: int = 1012) -> DataFrame:
    """(name, pos, split, rank) for a table of files (name, n rows): a permutation's first half is dev, the rest test,
    and rank is a row's place in its half.

    A file's permutation is numpy's and made in one task, as it must be that one: files are of evaluation size, and the
    memory is sixteen bytes a row. Larger tables are split by shuffled_split() or hash_split(). A join with it shuffles:
    the size that Spark expects of it is that of the table of files.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                places = shuffled_places(n, name, seed)
                for i in range(0, n, 1 << 16):
                    at = places[i : i + (1 << 16)]
                    dev = at < n // 2
                    columns = [pa.array([name] * len(at)), pa.array(np.arange(i, i + len(at))), pa.array(np.where(dev, "dev", "test")), pa.array(np.where(dev, at, at - n // 2))]
                    yield pa.RecordBatch.from_arrays(columns, ["name", "pos", "split", "rank"])

    return files.select(F.col("name").cast("string"), F.col("n").cast("long")).mapInArrow(split, "name string, pos long, split string, rank long").hint("merge")


def half_split(spark: SparkSession, n: int, name: str, seed: int = 1012) -> DataFrame:
    """(pos, split, rank) of one file of n rows, see half_splits()."""
    return half_splits(spark.createDataFrame([(name, n)], "name string, n long"), seed).drop("name")


def shuffled_split(df: DataFrame, key: str, seed: int, eval_share: float) -> DataFrame:
    """df in a seeded order (pos), the first ceil((1 - eval_share) n) of its rows 'train' and the rest 'eval'."""
    placed = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")))
    placed = positions(placed, "_h", key).drop("_h")
    n = math.ceil((1 - eval_share) * df.count())
    return placed.withColumn("split", F.when(F.col("pos") < n, "train").otherwise("eval"))


def held_out(df: DataFrame, key: str, seed: int, eval_share: float, most: int = 64) -> DataFrame:
    """The first `most` rows of shuffled_split()'s 'eval' part, in its order; all of them if most is 0.

    Evaluation generates from a model for each of these rows, hence the limit.
    """
    rows = shuffled_split(df, key, seed, eval_share).filter("split = 'eval'").drop("split")
    return rows.orderBy("pos").limit(most) if most else rows


def in_order(x: Column, names: list[str]) -> Column:
    """A sort key for names in an order of their own; others come last, by name."""
    return F.struct(F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), x), F.lit(0)), F.lit(len(names) + 1)), x)


def sample_pairs(df: DataFrame, keys: list[str], sample: str, value: str, per_prompt: int = 2) -> DataFrame:
    """The per_prompt values of each prompt as one array, by sample; prompts with fewer samples have nulls there."""
    at = [F.max(F.when(F.col(sample) == i, F.col(value))) for i in range(1, per_prompt + 1)]
    return df.groupBy(*keys).agg(F.array(*at).alias("pair"))


def hash_split(df: DataFrame, key: Column, seed: int, share: float) -> DataFrame:
    """split 'train' for about `share` of the keys and 'eval' for the rest, by a hash: no order, no shuffle."""
    place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return df.withColumn("split", F.when(place < F.lit(int(share * 2**32)), "train").otherwise("eval"))
