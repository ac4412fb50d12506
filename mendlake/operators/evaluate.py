"""Suites of test results to pass counts, first failures and targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendlake.functions.text import stdout


def pct(passed: Column, total: Column) -> Column:
    """Percent passed; 0 of an empty suite."""
    return 100.0 * passed / F.greatest(total, F.lit(1))


def suite_counts(results: DataFrame, keys: list[str], ok: str = "ok", expected: str | None = None) -> DataFrame:
    """passed, total, acc_pct and problem_passed by suite. expected: a column with the number of tests that the suite
    has; results that are missing then count as failed."""
    passed = F.count_if(F.col(ok))
    total = F.count(F.lit(1)) if expected is None else F.greatest(F.count(F.lit(1)), F.max(expected).cast("long"))
    out = results.groupBy(*keys).agg(passed.alias("passed"), total.alias("total"))
    return out.withColumn("acc_pct", pct(F.col("passed"), F.col("total"))).withColumn("problem_passed", (F.col("total") > 0) & (F.col("passed") == F.col("total")))


def first_failing(results: DataFrame, keys: list[str], index: str, ok: str = "ok", default: int = -1) -> DataFrame:
    """The least index that failed, default where none did."""
    low = F.min(F.when(~F.coalesce(F.col(ok), F.lit(False)), F.col(index)))
    return results.groupBy(*keys).agg(F.coalesce(low, F.lit(default)).alias("target_index"))


def reselect_target(selected: Column, selected_ok: Column, first_failed: Column) -> Column:
    """A selected test that passes is no target: the first failing one takes its place."""
    return F.when(F.coalesce(selected_ok, F.lit(True)) | (selected < 0), first_failed).otherwise(selected)


def gold_correctness(results: DataFrame, keys: list[str], reported: str, ok: str = "ok") -> DataFrame:
    """correct, incorrect, total (the larger of reported and counted) and the rate of a suite run on the gold code."""
    agg = results.groupBy(*keys).agg(F.count_if(F.col(ok)).alias("correct"), F.greatest(F.max(reported).cast("long"), F.count(F.lit(1))).alias("total"))
    return agg.withColumn("incorrect", F.greatest(F.lit(0), F.col("total") - F.col("correct"))).withColumn("rate", F.col("correct") / F.greatest("total", F.lit(1)))


def program_report(ran: DataFrame, keys: list[str], index: str, expected: str, target: int = 0) -> DataFrame:
    """Programs by test (run_programs() with the test's number and expected output) as suite counts, and whether the
    target test passed and what the program printed there."""
    ok = F.col("ok_process") & (stdout(F.col("stdout")) == stdout(F.col(expected)))
    at = F.col(index) == target
    out = ran.withColumn("_ok", ok).groupBy(*keys).agg(F.count_if("_ok").alias("passed"), F.count(F.lit(1)).alias("total"), F.coalesce(F.bool_or(at & F.col("_ok")), F.lit(False)).alias("target_ok"), F.max(F.when(at, F.col("stdout"))).alias("target_got"))
    return out.withColumn("acc_pct", pct(F.col("passed"), F.col("total"))).withColumn("problem_passed", (F.col("total") > 0) & (F.col("passed") == F.col("total")))


def line_coverage(lines: DataFrame, keys: list[str], code: str, line: str) -> DataFrame:
    """Percent of the non-blank lines of code that occur among the executed lines (numbered from 1)."""
    hit = lines.groupBy(*keys, code).agg(F.count_distinct(line).alias("hit"))
    full = F.size(F.filter(F.split(code, "\n"), lambda x: F.trim(x) != ""))
    return hit.select(*keys, (100.0 * F.least("hit", full) / F.greatest(full, F.lit(1))).alias("coverage_pct"))
