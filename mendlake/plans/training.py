"""Plans of training rows: per-problem caps, a global cap, a top-up from what is left, and a split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendlake.operators.ordering import capped, hash_split

CAP, SIZE, EVAL_SHARE, SEED = 10, 3000, 0.1, 1012


def shuffled(key: str, seed: int) -> list:
    """A seeded order of rows by key: the same whatever their partitions."""
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), F.col(key)]


def training_plan(failing: DataFrame, problem: list[str], row_id: str, cap: int = CAP, size: int = SIZE, seed: int = SEED) -> DataFrame:
    """At most cap failing tests a problem in a seeded order, at most `size` in all; if they are fewer, other failing
    tests follow without the cap. Adds pick (1 capped, 2 top-up) and split.

    One ranked window by problem and one top-`size` sort; the top-up's order puts first picks first, so both passes
    are a single limit.
    """
    order = shuffled(row_id, seed)
    first = capped(failing, problem, cap, *order).select(row_id, F.lit(1).alias("pick"))
    picked = failing.join(first, row_id, "left").withColumn("pick", F.coalesce("pick", F.lit(2)))
    plan = picked.orderBy("pick", *order).limit(size)
    return hash_split(plan, F.col(row_id), seed, 1 - EVAL_SHARE)


def test_plan(problems: DataFrame, excluded: DataFrame, key: str, required: list[str], seed: int = SEED) -> DataFrame:
    """Problems with all required texts that aren't excluded, split by a seeded hash."""
    full = problems.filter(" and ".join(f"length(trim(coalesce({c}, ''))) > 0" for c in required))
    return hash_split(full.join(excluded.select(key).distinct(), key, "left_anti"), F.col(key), seed, 1 - EVAL_SHARE)
