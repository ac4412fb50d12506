"""Look-ups with the rules that repair pipelines use: who wins among duplicates, aliases, fallbacks, what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def last_wins(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key in a total order: replay of an append-only log."""
    return first_wins(df, keys, *[F.desc(c) for c in order])


def key_text(key: Column) -> Column:
    """One text for a key that is kept as text on one side and as a number on the other: 7, '7' and '07' are '7'."""
    text = F.trim(key.cast("string"))
    return F.coalesce(text.try_cast("long").cast("string"), text)


def priority_pick(df: DataFrame, keys: list[str], tag: str, priority: list[str], index: str, value: str) -> DataFrame:
    """value of each key's first row by the tag's place in priority (10000 for others), tag and index."""
    named = F.array(*map(F.lit, priority)) if priority else F.array().cast("array<string>")
    place = F.coalesce(F.nullif(F.array_position(named, F.col(tag)), F.lit(0)) - 1, F.lit(10_000))
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(place, F.col(tag), F.col(index))).alias(value))


def lookup(df: DataFrame, side: DataFrame, keys: list[str], missing: str = "missing_dataset_row") -> DataFrame:
    """df with the columns of side (one row a key) and status: 'ok', or `missing` where side has no such key."""
    marked = side.withColumn("_there", F.lit(True))
    return df.join(marked, keys, "left").withColumn("status", F.when(F.col("_there"), "ok").otherwise(missing)).drop("_there")


def alias_lookup(df: DataFrame, probes: list[Column], side: DataFrame, aliases: list[Column], order: list[str], value: list[str]) -> DataFrame:
    """df with `value` of the side row that its first matching probe names.

    aliases: the names of a side row, one a probe level; for each level and name the first side row in `order` wins.
    The levels are one join on (level, name) of the exploded probes, and the lowest level that matched is kept; df
    must have a column row_id that is unique.
    """
    named = side.select(*dict.fromkeys([*order, *value]), F.posexplode(F.array(*aliases)).alias("_level", "_name")).filter("_name is not null")
    named = first_wins(named, ["_level", "_name"], *order).select("_level", "_name", F.struct(*value).alias("_value"))
    asked = df.select("row_id", F.posexplode(F.array(*probes)).alias("_level", "_name"))
    hit = asked.join(named, ["_level", "_name"]).groupBy("row_id").agg(F.min(F.struct("_level", "_value")).alias("_hit"))
    return df.join(hit, "row_id", "left").select(df["*"], F.col("_hit._level").alias("alias_level"), *[F.col(f"_hit._value.{v}") for v in value])


def reference_or(primary: DataFrame, secondary: DataFrame, keys: list[str], value: str, names: tuple[str, str]) -> DataFrame:
    """value of primary, else of secondary, with its source; keys that neither has are gone."""
    one, two = primary.select(*keys, F.col(value).alias("_one")), secondary.select(*keys, F.col(value).alias("_two"))
    out = one.join(two, keys, "full")
    return out.select(*keys, F.coalesce("_one", "_two").alias(value), F.when(F.col("_one").isNotNull(), names[0]).otherwise(names[1]).alias("source"))


def few_shot(df: DataFrame, eligible: DataFrame, group: list[str], row_id: str, k: int, *order: str) -> DataFrame:
    """The ids of the first k eligible rows of a row's group that are not the row itself (shots).

    Only the first k + 1 eligible rows of a group can be needed if ids are unique; they are found by a ranked window
    and joined on the group as one small array.
    """
    n = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    top = eligible.withColumn("_n", n).filter(F.col("_n") <= k + 1).groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(row_id).alias("_id")))), lambda x: x["_id"]).alias("_top"))
    out = df.join(top, group, "left")
    shots = F.slice(F.filter(F.coalesce("_top", F.array().cast("array<bigint>")), lambda x: x != F.col(row_id)), 1, k)
    return out.withColumn("shots", shots).drop("_top")


def excluded(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """df without the ids, and how many of the ids df had (one row)."""
    present = ids.select(key).distinct().join(df.select(key).distinct(), key, "left_semi").agg(F.count(F.lit(1)).alias("n_excluded"))
    return df.join(ids.select(key).distinct(), key, "left_anti"), present


def with_experiments(df: DataFrame, experiments: DataFrame) -> DataFrame:
    """Every row for every experiment: a fixed dimension of about ten rows."""
    return df.join(F.broadcast(experiments), how="cross")
