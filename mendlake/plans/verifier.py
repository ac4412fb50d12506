"""From problems, gold and buggy programs and generated suites to the report on the suites' quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendlake.functions import code, sandbox
from mendlake.operators.evaluate import pct
from mendlake.operators.rewards import rate_error


def counted(df: DataFrame, name: str) -> DataFrame:
    """Results of run_suites() as counts; the total is the number of asserts of the suite, missing ones failed."""
    passed = F.size(F.filter("results", lambda r: r["ok"]))
    total = F.greatest("n_asserts", F.size("results"))
    return df.withColumn(f"{name}_passed", passed).withColumn(f"{name}_total", total).withColumn(f"{name}_error", F.col("error_type")).drop("results", "error_type", "error_msg", "lines", "n_asserts", "code")


def evaluated(df: DataFrame) -> DataFrame:
    """df: key, gold, buggy, tests, entry, actual_pct. Gold correctness, the buggy program's pass rate by generated tests
    and its error against the actual one. Both programs go through the sandbox in one pass."""
    both = df.select("key", "tests", "entry", F.inline(F.array(F.struct(F.lit("gold").alias("who"), F.col("gold").alias("code")), F.struct(F.lit("buggy").alias("who"), F.col("buggy").alias("code")))))
    ran = counted(sandbox.run_suites(both), "n")
    of = lambda who, c: F.max(F.when(F.col("who") == who, F.col(c)))
    wide = ran.groupBy("key").agg(of("gold", "n_passed").alias("gold_passed"), of("gold", "n_total").alias("total"), of("buggy", "n_passed").alias("buggy_passed"), of("buggy", "n_error").alias("buggy_error"))
    rates = wide.join(df.select("key", "actual_pct"), "key").withColumn("predicted_pct", F.when(F.col("total") > 0, pct(F.col("buggy_passed"), F.col("total"))))
    return rates.withColumn("error", rate_error(F.col("predicted_pct"), F.col("actual_pct")))


def gold_asserts(df: DataFrame) -> DataFrame:
    """df: key, gold, tests, entry. A row for each assert that stands directly in a suite's check: index, source, ok on
    the gold program, stdout, error_type, error_msg. An assert that check doesn't reach is not ok."""
    ran = sandbox.run_suites(df.select("key", F.col("gold").alias("code"), "tests", "entry"))
    each = ran.withColumn("sources", code.check_assert_texts("tests")).select("*", F.posexplode("sources").alias("index", "source"))
    one = sandbox.single_result(F.col("results"), F.size("sources"), F.col("index"), F.col("error_msg"))
    return each.select("key", "index", "source", one.alias("r")).select("key", "index", "source", "r.*")


def gold_suites(df: DataFrame) -> DataFrame:
    """df: key, gold, tests, entry. n_asserts, correct, and tests: the suite anew of its asserts about the candidate that
    the gold program passes, each once. A suite without asserts, or one that doesn't parse, becomes an empty one."""
    ran = sandbox.run_suites(df.select("key", F.col("gold").alias("code"), "tests", "entry")).withColumn("sources", code.check_assert_texts("tests"))
    ok = F.transform("sources", lambda _, i: F.coalesce(F.get("results", i)["ok"], F.lit(False)))
    return ran.select("key", F.size("sources").alias("n_asserts"), F.size(F.filter(ok, lambda x: x)).alias("correct"), code.rebuilt(F.col("sources"), ok).alias("tests"))
