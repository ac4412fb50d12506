"""Totals, micro-averages, roll-ups, histograms and batch statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mendlake.operators.evaluate import pct

#: Equal-width buckets of a key's values in exact_percentile().
BUCKETS = 1000


def unpivot_modes(df: DataFrame, keep: list[str], modes: dict[str, list[Column]], names: list[str]) -> DataFrame:
    """A row for each mode with its measures (names)."""
    rows = F.array(*[F.struct(F.lit(m).alias("mode"), *[c.alias(n) for c, n in zip(cols, names, strict=True)]) for m, cols in modes.items()])
    return df.select(*keep, F.inline(rows))


def totals(source: Column | None = None, denominator: Column | None = None) -> list[Column]:
    """Aggregates of rows with passed, total, problem_passed and target_ok; percents are of sums, not means."""
    n = F.count(F.lit(1)) if denominator is None else F.max(denominator)
    out = [
        F.count(F.lit(1)).alias("n_problems"), F.sum("passed").cast("long").alias("passed"), F.sum("total").cast("long").alias("total"),
        pct(F.sum("passed"), F.sum("total")).alias("overall_pct"), F.count_if("problem_passed").alias("n_solved"),
        pct(F.count_if("problem_passed"), n).alias("solved_pct"), F.count_if("target_ok").alias("n_fixed"), pct(F.count_if("target_ok"), n).alias("fixed_pct"),
    ]
    if source is not None:
        out += [F.count_if(source.startswith("generation")).alias("from_generation"), F.count_if(source.startswith("debug")).alias("from_debug")]
    return out


def rolled_up(df: DataFrame, dims: list[str], aggs: list[Column]) -> DataFrame:
    """Metrics of every prefix of dims in one pass; level says how many dims are rolled up."""
    return df.rollup(*dims).agg(F.grouping_id().alias("level"), *aggs)


def category_counts(df: DataFrame, keys: list[str], category: Column) -> DataFrame:
    """Rows by category; null and blank ones are 'unknown'."""
    return df.withColumn("category", F.coalesce(F.nullif(F.trim(category), F.lit("")), F.lit("unknown"))).groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("n"))


def category_map(counts: DataFrame, keys: list[str]) -> DataFrame:
    """category_counts() as a map with sorted keys."""
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("source_counts"))


def error_report(error: Column) -> list[Column]:
    """Mean and mean absolute error over rows with one; 0 without any."""
    return [F.count(error).alias("n_errors"), F.coalesce(F.avg(error), F.lit(0.0)).alias("me"), F.coalesce(F.avg(F.abs(error)), F.lit(0.0)).alias("mae")]


def batch_stats(x: str) -> list[Column]:
    """Mean, population deviation, maximum and share above zero; 0 where there is no row. See exact_percentile() too."""
    zero = lambda c, n: F.coalesce(c, F.lit(0.0)).alias(n)
    return [F.count(x).alias("n"), zero(F.avg(x), "mean"), zero(F.stddev_pop(x), "std"), zero(F.max(x), "max"), zero(F.avg((F.col(x) > 0).cast("double")), "positive_rate")]


def verifier_totals(problem: list[str], wellformed: str, n_tests: str, fallback: str) -> list[Column]:
    """Distinct problems, rows a problem, share of well-formed suites, tests a suite, and problems with a fallback."""
    n = F.count(F.lit(1))
    problems = F.count_distinct(F.struct(*problem))
    rate = F.coalesce(F.avg(F.coalesce(F.col(wellformed), F.lit(False)).cast("int")), F.lit(0.0))
    return [problems.alias("n_problems"), (n / F.greatest(problems, F.lit(1))).alias("per_problem"), rate.alias("wellformed_rate"), F.coalesce(F.avg(n_tests), F.lit(0.0)).alias("avg_tests"), F.count_if(fallback).alias("n_fallback")]


def nan_mean(x: Column) -> Column:
    """Mean over what is neither null nor NaN; 0 without any."""
    return F.coalesce(F.avg(F.when(~F.isnan(x), x)), F.lit(0.0))


def exact_percentile(df: DataFrame, keys: list[str], x: str, share: float, name: str = "p95") -> DataFrame:
    """(keys, name): the percentile with linear interpolation. Equal values are counted first, and running counts over
    the counted values, a bucket of them at a time, tell the two values between which it lies, so that no task holds
    all values of a key."""
    counts = df.filter(F.col(x).isNotNull()).groupBy(*keys, F.col(x).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ends = counts.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_all"))
    width = (F.col("_hi") - F.col("_lo")) / BUCKETS
    bucket = F.when(width > 0, F.least(F.lit(BUCKETS - 1), F.floor((F.col("_v") - F.col("_lo")) / width))).otherwise(F.lit(0)).cast("int")
    dealt = counts.join(ends, keys).withColumn("_b", bucket)
    sums = dealt.groupBy(*keys, "_b").agg(F.sum("_n").alias("_in"), F.max("_all").alias("_all"))
    before = F.sum("_in").over(W.partitionBy(*keys).orderBy("_b")) - F.col("_in")
    at = (F.col("_all") - 1) * share
    sums = sums.withColumn("_before", before).filter((F.ceil(at) >= F.col("_before")) & (F.floor(at) < F.col("_before") + F.col("_in"))).select(*keys, "_b", "_before")
    inner = dealt.join(sums, [*keys, "_b"])
    last = F.col("_before") + F.sum("_n").over(W.partitionBy(*keys, "_b").orderBy("_v")) - 1  # the place of a value's last row
    inner = inner.withColumn("_last", last).withColumn("_first", F.col("_last") - F.col("_n") + 1)
    low, high = (F.max(F.when((F.col("_first") <= f(at)) & (F.col("_last") >= f(at)), F.col("_v"))) for f in (F.floor, F.ceil))
    part = F.max(at - F.floor(at))
    return inner.groupBy(*keys).agg((low + (high - low) * part).alias(name))


def histogram(df: DataFrame, x: str, bins: int = 20) -> DataFrame:
    """Counts of equal-width bins between the extremes; the maximum falls in the last bin. Two scans, no sort."""
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    joined = df.filter(F.col(x).isNotNull()).select(x).join(F.broadcast(ends))  # one row
    at = F.when(F.col("hi") == F.col("lo"), F.lit(bins // 2)).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(x) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)))
    return joined.groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
