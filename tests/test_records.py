import pytest
from mendlake.functions import records
from mendlake.plans import options
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_kept_tests(spark):
    tests, ok = F.array(*map(F.lit, ("a candidate", "b", "c candidate", "a candidate"))), F.array(F.lit(True), F.lit(True), F.lit(False))
    assert one(spark, records.passed_tests(tests, ok)) == ["a candidate", "b"]
    assert one(spark, records.gold_asserts(tests, F.array(*[F.lit(True)] * 4))) == ["a candidate", "c candidate"]


def test_tokens(spark):
    tokens = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, records.generated_tokens(tokens(1, 2, 3, 9, 4), F.lit(2), 9)) == [4]
    assert one(spark, records.generated_tokens(tokens(1, 2, 3, 4), F.lit(2), 9)) == [3, 4]
    assert one(spark, records.generated_tokens(tokens(1, 9, 9), F.lit(1), 9)) == []
    assert one(spark, records.generated_tokens(tokens(1), F.lit(5), 9)) == []


def test_prompts_and_ids(spark):
    assert one(spark, records.fitting_prompt(F.lit("abcdef"), F.lit("abc"), 4)) == "abc"
    assert one(spark, records.fitting_prompt(F.lit("abcdef"), F.lit("abcde"), 4)) is None
    assert one(spark, records.or_missing_id(F.lit(None).cast("string"), F.lit(4))) == "__missing_task_id_4"
    assert one(spark, records.row_key(F.lit("a"), F.lit(None), F.lit(3))) == "a||||||3"
    got = one(spark, records.public_view(F.struct(F.lit(1).alias("a"), F.lit("long").alias("details")), "details"))
    assert got.asDict() == {"a": 1}


def test_options(spark):
    df = spark.range(20).select((19 - F.col("id")).alias("k"))
    got = options.Options(start=2, end=12, n_shards=5, shard=3).rows(df, "k").collect()
    assert sorted(r["k"] for r in got) == [3, 8]
    assert options.Options(limit=4).rows(df, "k").count() == 4
    with pytest.raises(ValueError):
        options.Options(n_shards=2, shard=2)
    with pytest.raises(ValueError, match="entry"):
        options.evaluate("assert", df.select(F.lit("x").alias("code"), F.lit("x").alias("tests")))


def test_observed(spark):
    df, seen = options.observed(spark.range(7), "rows", top=F.max("id"))
    df.count()
    assert seen.get == {"rows": 7, "top": 6}
