"""Arrow files, banks, batch rewards and metrics of streams on small cases."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from mendlake.plans import file_queries, queries, rewarding
from mendlake.sources import arrow_files, readers
from mendlake.streaming import metrics
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write(path, *batches):
    path.parent.mkdir(parents=True, exist_ok=True)
    with pa.OSFile(str(path), "wb") as f, pa.ipc.new_file(f, batches[0].schema) as out:
        for b in batches:
            out.write_batch(b)


def batch(ids, texts):
    return pa.record_batch({"id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "tags": pa.array([["x", None]] * len(ids), pa.list_(pa.string()))})


def test_arrow_files(spark, tmp_path):
    """Record batches of several files, nulls and empty batches; a task a batch, or for several; some columns only."""
    write(tmp_path / "a" / "one.arrow", batch([1, None], ["é", None]), batch([], []), batch([3], [""]))
    write(tmp_path / "b.arrow", batch([4], ["d"]))
    (tmp_path / "notes.txt").write_text("no Arrow")
    df = arrow_files.read_arrow(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 4 and dict(df.dtypes)["tags"] == "array<string>"
    assert sorted(map(str, df.select("id", "text").collect())) == sorted(map(str, spark.createDataFrame([(1, "é"), (None, None), (3, ""), (4, "d")], "id long, text string").collect()))
    assert arrow_files.read_arrow(spark, f"file://{tmp_path}", batches=8).rdd.getNumPartitions() == 2
    assert arrow_files.read_arrow(spark, str(tmp_path / "b.arrow"), T.StructType().add("text", T.StringType())).collect() == [("d",)]
    back = f"file://{tmp_path}/back"
    assert arrow_files.write_arrow(df, back) == 4 and arrow_files.read_arrow(spark, back).count() == 4
    assert arrow_files.write_arrow(df.limit(0), f"{back}-none") == 0


def test_bank_takes_the_first_source_with_problems(spark, tmp_path):
    write(tmp_path / "bank" / "x.arrow", batch([1], [" p1 "]), batch([2, 3, 4], ["p1", "", None]), batch([5], ["p2"]))
    spark.createDataFrame([], "text string").write.parquet(str(tmp_path / "empty"))
    sources = [("arrow", str(tmp_path / "gone")), ("parquet", str(tmp_path / "gone")), ("parquet", str(tmp_path / "empty"))]
    got = readers.problem_bank(spark, [*sources, ("arrow", str(tmp_path / "bank"))], "text", "id")
    assert sorted((r["text"], r["id"]) for r in got.collect()) == [("p1", 1), ("p2", 5)]
    with pytest.raises(ValueError, match="gone.*; parquet .*; parquet .*empty: no problems"):
        readers.problem_bank(spark, sources, "text")
    with pytest.raises(ValueError, match="no column task"):
        readers.problem_bank(spark, [("arrow", str(tmp_path / "bank"))], "task")


def test_file_or_folder(spark, tmp_path):
    (tmp_path / "m" / "sub").mkdir(parents=True)
    file = tmp_path / "m" / "sub" / "a_bug_farm.jsonl"
    file.write_text('{"x": 1}\n')
    assert readers.files_or_folder(spark, str(file), "*_bug_farm.jsonl") == str(file)
    found = readers.files_or_folder(spark, str(tmp_path / "m"), "*_bug_farm.jsonl")
    assert spark.read.json(found).select(readers.parent_folder(F.col("_metadata.file_path"))).collect() == [("sub",)]


TESTS = "def check(candidate):\n    assert candidate(1) == 2\n    assert candidate(2) == 4"


def test_batch_rewards(spark):
    """A batch's rewards are those of the formula row by row; nulls, repeated rows and several batches."""
    rows = [
        (0, "def f(x): return 2 * x", TESTS, "f", 0, 2, 1000.0), (0, "def f(x): return 2 * x", TESTS, "f", 2, 2, 0.0), (0, "def f(x): return 2", TESTS, "f", 1, 2, 0.0), (1, "def f(x): return 0", TESTS, None, 1, 2, -500.0),
        (1, "def f(", TESTS, "f", 1, 2, 0.0), (1, None, TESTS, "f", 1, 2, 0.0), (2, "def f(x): return x", None, "f", None, None, 0.0),
    ]
    df = spark.createDataFrame(rows, "batch long, completion string, tests string, entry string, passed_before int, total int, want double")
    got = rewarding.rewarded(df, "repair", "batch").collect()
    assert len(got) == 7 and all(r["reward"] == r["want"] for r in got)
    assert rewarding.rewarded(df.limit(0), "repair", "batch").count() == 0
    with pytest.raises(ValueError, match="repair needs tests, total"):
        rewarding.rewarded(df.drop("tests", "total"), "repair", "batch")
    with pytest.raises(ValueError, match="reward"):
        rewarding.rewarded(df.withColumn("reward", F.lit(1)), "repair", "batch")


def test_batch_rewards_of_tests(spark):
    many = "def check(candidate):\n" + "\n".join(f"    assert candidate({i}) == {2 * i + (i == 9)}" for i in range(12))
    rows = [(0, many, 1000.0 * 11 / 12 + 200), (0, TESTS, 0.0), (0, "def check(", -200.0), (0, "x = 1", -200.0), (0, "def check(candidate):\n    pass", -200.0), (0, None, -200.0)]
    df = spark.createDataFrame(rows, "batch long, completion string, want double").withColumns({"gold": F.lit("def f(x): return 2 * x"), "entry": F.lit("f")})
    assert all(abs(r["reward"] - r["want"]) < 1e-9 for r in rewarding.rewarded(df, "tests", "batch").collect())


def test_wrong_number_of_rewards_fails(spark):
    rewarding.reward("short", "n")(lambda columns: columns["n"][1:])
    with pytest.raises(Exception, match="rewards of"):
        rewarding.rewarded(spark.range(3).selectExpr("id as n", "1 as batch"), "short", "batch").collect()


def test_metrics_of_batches(spark, tmp_path):
    """Each batch's rows, nulls, extremes and bins; a batch told of twice counts once."""
    for i, values in enumerate([[1.0, 99.0, None], [50.0], [-5.0, 200.0]]):
        spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    told = metrics.MetricTable(spark, str(tmp_path / "out"), every=2)
    stream = spark.readStream.schema("v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = metrics.measured(stream, "m", "v", 0.0, 100.0).writeStream.queryName("q").format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = told.close()
    got = sorted(tuple(r) for r in metrics.by_batch(rows.unionByName(rows)).select("rows", "nulls", "sum", "least", "most", F.array_position("bins", 1), F.expr("aggregate(bins, 0L, (a, b) -> a + b)")).collect())
    assert got == [(1.0, 0.0, 50.0, 50.0, 50.0, 11, 1), (2.0, 0.0, 195.0, -5.0, 200.0, 1, 2), (3.0, 1.0, 100.0, 1.0, 99.0, 1, 2)]


def test_each_files_halves(spark, sf, tmp_path):
    """Rows of several files, with fields of several lines, in the order of each file's own permutation."""
    want = {}
    for name, n in (("one.tsv", 7), ("two.tsv", 2), ("three.tsv", 301)):
        (tmp_path / name).write_text("id\ttext\n" + "".join(f'{name}-{i}\t"a\nb ""{i}"""\n' for i in range(n)))
        order = np.arange(n)
        np.random.RandomState(1012 + int(hashlib.md5(name.encode()).hexdigest()[:8], 16)).shuffle(order)
        want[name] = ([f"{name}-{i}" for i in order[: n // 2]], [f"{name}-{i}" for i in order[n // 2 :]])
    for mode, k in (("dev", 0), ("test", 1)):
        rows = readers.tsv_halves(spark, f"{tmp_path}/*.tsv", mode).orderBy("rank").collect()
        got = {name: [r["id"] for r in rows if r["source_tsv"].endswith(f"/{name}")] for name in want}
        assert got == {name: halves[k] for name, halves in want.items()}
    every = readers.tsv_halves(spark, f"{tmp_path}/*.tsv")
    assert every.count() == 310 and all(r["id"].endswith(f"-{r['pos']}") for r in every.collect())
    with pytest.raises(ValueError, match="mode"):
        readers.tsv_halves(spark, f"{tmp_path}/*.tsv", "train")
    rows = file_queries.split_files(spark, sf).collect()
    ids = {}
    for r in rows:
        ids.setdefault(r["o_orderstatus"], {})[r["pos"]] = (int(r["o_orderkey"]), r["split"], r["rank"])
    assert len(rows) == spark.read.parquet(f"{sf}/orders.parquet").count()
    for status, placed in ids.items():
        order = np.arange(len(placed))
        np.random.RandomState((1012 + int(hashlib.md5(f"of={status}".encode()).hexdigest()[:8], 16)) % 2**32).shuffle(order)
        assert sorted(placed) == list(range(len(placed))) and [placed[i][0] for i in range(len(placed))] == sorted(x[0] for x in placed.values())
        assert {i: placed[i][1:] for i in order[: len(order) // 2].tolist()} == {i: ("dev", k) for k, i in enumerate(order[: len(order) // 2].tolist())}


def test_halves_are_never_broadcast(spark, sf):
    """A permutation has a row for each row of its file, though the table of files is small."""
    for df in (file_queries.split_files(spark, sf), queries.QUERIES["half_split_rows"](spark, sf)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in re.findall(r"(\w+) \[[^\]]*pos#", plan) and not re.search(r"BroadcastHashJoin \[[^\]]*pos#", plan), plan


def test_batches_are_dealt_to_all_cores(spark):
    """A batch has few bytes but a child for each row, so its size says nothing of its work."""
    df = spark.range(64).selectExpr("id div 4 as batch", "'def f(' as completion", "'' as tests", "'f' as entry", "0 as passed_before", "1 as total")
    got = rewarding.rewarded(df, "repair", "batch")
    assert got.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert [r["reward"] for r in got.collect()] == [0.0] * 64
