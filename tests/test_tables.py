"""Readers, writers, order, splits and plans."""

import hashlib
import json

import numpy as np
import pytest
from mendlake.functions import nested, text
from mendlake.operators import evaluate, joins, metrics, ordering, selection
from mendlake.plans import experiments, options, queries, training
from mendlake.schemas import BUGGY_REQUIRED, SUMMARY_EVENT
from mendlake.sources import readers, sinks
from pyspark.sql import functions as F
from pyspark.sql import types as T


def test_tsv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x\n"y"\tz', None), ("b", "", "q")], "id string, code string, note string")
    sinks.write_tsv(df, str(tmp_path / "t"))
    back = readers.tsv(spark, str(tmp_path / "t")).na.fill("").orderBy("id").collect()
    assert [tuple(r) for r in back] == [("a", 'x\n"y"\tz', ""), ("b", "", "q")]


def test_buggy_rows(spark):
    names = [c.upper() if c != "buggy_code" else "prediction" for c in BUGGY_REQUIRED]
    df = spark.createDataFrame([tuple("7.9" if "BASE" in n else None if n == "QUERY" else "x" for n in names)], T.StructType([T.StructField(n, T.StringType()) for n in names]))
    row = readers.buggy_rows(df).first()
    assert row["baseline_total"] == 7 and row["selected_assert_index"] == 0 and row["query"] == "" and row["buggy_code"] == "x"
    with pytest.raises(ValueError, match="query"):
        readers.buggy_rows(df.drop("QUERY"))


def test_torn_log(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"event":"final_metrics","task_id":"a","baseline_eval":{"full_suite_passed":1}}\n\n{"event":"fin')
    assert readers.json_lines(spark, str(tmp_path / "log.jsonl"), SUMMARY_EVENT).count() == 1
    assert [r["task_id"] for r in readers.json_lines(spark, str(tmp_path / "log.jsonl"), SUMMARY_EVENT).collect()] == ["a"]
    with pytest.raises(Exception):  # noqa: B017
        readers.json_lines(spark, str(tmp_path / "log.jsonl"), SUMMARY_EVENT, strict=True).collect()


def test_id_list(spark, tmp_path):
    (tmp_path / "ids.json").write_text(json.dumps([" a ", "b", "", "a"]))
    assert [r[0] for r in readers.id_list(spark, str(tmp_path / "ids.json")).collect()] == ["a", "b"]
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError):
        readers.id_list(spark, str(tmp_path / "bad.json"))


def test_splits_and_fallbacks(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([(1, "dev"), (2, "test")], "x int, split string").write.partitionBy("split").parquet(path)
    assert readers.split_of(spark, path, "dev").select("x").first()[0] == 1
    with pytest.raises(ValueError):
        readers.split_of(spark, path, "train")
    assert readers.first_readable(spark, [str(tmp_path / "no"), path]).count() == 2
    with pytest.raises(ValueError, match="no"):
        readers.first_readable(spark, [str(tmp_path / "no")])
    assert readers.or_empty(spark, str(tmp_path / "no"), SUMMARY_EVENT).count() == 0


def test_half_split_is_the_permutation(spark):
    files = spark.createDataFrame([("a.tsv", 9), ("b.tsv", 100_000), ("c.tsv", 0)], "name string, n long")
    got = ordering.half_splits(files).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "dev").alias("dev")).collect()
    assert {r["name"]: (r["n"], r["dev"]) for r in got} == {"a.tsv": (9, 4), "b.tsv": (100_000, 50_000)}
    state = np.random.RandomState(1012 + int(hashlib.md5(b"a.tsv").hexdigest()[:8], 16))
    order = np.arange(9)
    state.shuffle(order)
    assert {r["pos"] for r in ordering.half_split(spark, 9, "a.tsv").filter("split = 'dev'").collect()} == set(order[:4].tolist())


def test_tasks_follow_the_rows(spark, sf, monkeypatch):
    """More rows are more tasks, not larger ones; one shuffle deals suites out for candidates, ranks and modes."""
    monkeypatch.setattr(ordering, "ROWS_A_TASK", 500)
    n = -(-queries.results(spark, sf).count() // 500)
    assert n > 4
    for df in (queries.gated(spark, sf), queries.chosen(spark, sf)):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        assert df.rdd.getNumPartitions() == n
    assert ordering.by_key(spark.range(3), "id").rdd.getNumPartitions() == 4
    assert queries.benchmarks_table(spark, sf).count() == len(experiments.EXPERIMENTS)


def test_missing_results(spark):
    labels = spark.createDataFrame([("x",), ("y",)], "experiment string")
    one = spark.createDataFrame([("x", 1.0)], "experiment string, overall double")
    with pytest.raises(ValueError, match="b has no results of y"):
        experiments.main_table({"a": one.unionByName(spark.createDataFrame([("y", 2.0)], one.schema)), "b": one}, labels)
    with pytest.raises(ValueError, match="missing experiment: y"):
        readers.missing_ids(labels, one, "experiment")


def test_cached_and_bad_previous(spark, tmp_path):
    path, calls = str(tmp_path / "r"), []
    make = lambda: calls.append(1) or spark.range(3)
    assert [options.cached(spark, path, make, force).count() for force in (False, False, True)] == [3, 3, 3] and len(calls) == 2
    (tmp_path / "bad.tsv").write_text("what\tis\nthis\n")
    assert readers.or_empty(spark, str(tmp_path / "bad.tsv"), SUMMARY_EVENT).count() == 0


def test_exact_percentile(spark):
    rng = np.random.default_rng(1)
    for values in (rng.normal(size=501), np.array([3.0]), np.array([1.0, 1.0, 2.0]), rng.integers(0, 4, 300).astype(float)):
        df = spark.createDataFrame([("k", float(v)) for v in values] + [("k", None)], "key string, x double")
        assert abs(metrics.exact_percentile(df, ["key"], "x", 0.95).first()["p95"] - np.quantile(values, 0.95)) < 1e-9


def test_half_split(spark):
    got = {r["pos"]: r["split"] for r in ordering.half_split(spark, 9, "a.tsv").collect()}
    assert sorted(got) == list(range(9)) and list(got.values()).count("dev") == 4
    assert got == {r["pos"]: r["split"] for r in ordering.half_split(spark, 9, "a.tsv").collect()}


def test_positions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), "id").repartition(7)
    got = ordering.positions(df, "k").collect()
    assert all(r["pos"] == r["k"] for r in got) and len(got) == 1000
    with pytest.raises(ValueError):
        ordering.shard(df, 3, 3, "k")


def test_caps_and_plan(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(100)], "id long, p int")
    plan = training.training_plan(df, ["p"], "id", cap=10, size=50).collect()
    assert len(plan) == 50 and sum(r["pick"] == 1 for r in plan) == 30 and len({r["id"] for r in plan}) == 50


def test_gates(spark):
    stdin, asserts = selection.POLICIES["stdin"], selection.POLICIES["assert"]
    df = spark.createDataFrame([(5, 3, 4), (3, 3, 4), (None, None, None), (0, 0, 0)], "s int, b int, t int")
    keep = lambda p: [r["g"]["keep"] for r in df.select(selection.verifier_gate(F.col("s"), F.col("b"), F.col("t"), p).alias("g")).collect()]
    assert keep(asserts) == [True, False, False, False] and keep(stdin) == [True, False, True, True]


def test_ties(spark):
    row = dict(debug_passed=3, debug_acc_pct=50.0, debug_problem_passed=False, debug_target_ok=True, generation_passed=3, generation_acc_pct=50.0, generation_problem_passed=False, generation_target_ok=True)
    df = spark.createDataFrame([row])
    assert [df.select(selection.route(selection.POLICIES[p])).first()[0] for p in ("assert", "stdin")] == ["debug", "generation"]


def test_expected_total_counts_missing_results(spark):
    df = spark.createDataFrame([(1, True, 4), (1, False, 4)], "s int, ok boolean, n int")
    assert tuple(evaluate.suite_counts(df, ["s"], expected="n").first()) == (1, 1, 4, 25.0, False)


def test_bounds(spark, sf):
    rows = queries.reward_passrate(spark, sf).collect()
    assert all(-1000 <= r["reward"] <= 1000 and 0 <= r["frac_improve"] <= 1 for r in rows)


def test_report_latex(spark, sf):
    tex = sinks.latex(queries.main_table_pivot(spark, sf).orderBy("experiment"), ["experiment"])
    assert tex.count(r"\\") == 1 + len(experiments.EXPERIMENTS) and r"debug\_none" in tex


def test_alias_levels(spark):
    side = spark.createDataFrame([(1, "x", "k"), (2, "x", "m")], "v long, a string, b string")
    df = spark.createDataFrame([(1, "x", "k"), (2, "q", "m"), (3, "q", "q")], "row_id long, a string, b string")
    got = joins.alias_lookup(df, [F.col("a"), F.col("b")], side, [F.col("a"), F.col("b")], ["v"], ["v"]).orderBy("row_id").collect()
    assert [(r["alias_level"], r["v"]) for r in got] == [(0, 1), (1, 2), (None, None)]


def test_held_out(spark):
    df = spark.range(1000).withColumnRenamed("id", "k").unionByName(spark.createDataFrame([(None,), (5,)], "k long"))
    every = [r["pos"] for r in ordering.held_out(df, "k", 1, 0.1, most=0).collect()]
    assert sorted(every) == list(range(902, 1002))
    assert sorted(r["pos"] for r in ordering.held_out(df, "k", 1, 0.1).collect()) == list(range(902, 966))
    assert ordering.held_out(df.limit(0), "k", 1, 0.1).count() == 0


def test_prompt_chars_are_those_of_json(spark):
    chats = [[], [("user", 'a "b"\n\u00e9\U0001f600\\ \x01')], [("system", ""), ("user", None), (None, "x, y: z")] * 2]
    df = spark.createDataFrame([(c,) for c in [*chats, None]], "chat array<struct<role:string,content:string>>")
    want = [len(json.dumps([{"role": r, "content": t} for r, t in c], ensure_ascii=False)) for c in chats]
    assert [r[0] for r in df.select(nested.prompt_chars(F.col("chat"))).collect()] == [*want, None]


def test_truncated_and_named(spark):
    df = spark.createDataFrame([("ab  \t\ncd", "a/b.tsv"), ("abcd", "b.tsv"), ("", "a/"), (None, None)], "x string, path string")
    got = df.select(text.truncated(F.col("x"), 5, "..."), text.truncated(F.col("x"), 4, "..."), text.basename(F.col("path"))).collect()
    assert [tuple(r) for r in got] == [("ab...", "ab...", "b.tsv"), ("abcd", "abcd", "b.tsv"), ("", "", ""), (None, None, None)]


def test_order_of_names(spark):
    df = spark.createDataFrame([(x,) for x in ("b", "z", None, "a", "b", "y")], "x string")
    got = [r[0] for r in df.orderBy(ordering.in_order(F.col("x"), ["b", "a"])).collect()]
    assert got == ["b", "b", "a", None, "y", "z"]


def test_occurrences_of_a_hot_key(spark):
    from pyspark.sql import functions as F

    rows = spark.range(3000).selectExpr("if(id % 3 = 0, id div 3 % 7, if(id % 3 = 1, null, -1)) AS k", "-id AS _pos", "'mine' AS _part")
    hot = ordering.occurrences(rows, ["k"], "_pos", name="n")
    assert hot.columns == ["k", "_pos", "_part", "n"] and hot.filter("_part = 'mine'").count() == 3000
    plain = rows.withColumn("n", ordering.occurrence(["k"], "_pos"))
    assert sorted(map(tuple, hot.select(F.coalesce("k", F.lit(-9)), "_pos", "n").collect())) == sorted(map(tuple, plain.select(F.coalesce("k", F.lit(-9)), "_pos", "n").collect()))
    assert ordering.occurrences(rows.limit(0), ["k"], "_pos").count() == 0


def _attempt(spark, rows):
    run = "struct<passed:bigint,total:bigint,acc_pct:double,problem_passed:boolean,target_ok:boolean>"
    some = "struct<passed:bigint,total:bigint>"
    return spark.createDataFrame(rows, f"task_id string, baseline {run}, debug {run}, generation {run}, verifier_debug {some}, verifier_generation {some}, verifier_baseline {some}, debug_sample int, generation_sample int, debug_code string, generation_code string, buggy_code string, note string, debug_prompt_chars bigint")


def test_attempts(spark):
    from mendlake.operators.selection import POLICIES
    from mendlake.plans import attempts

    assert [len(c) for c in attempts.LAYOUTS.values()] == [43, 37, 53]
    base, good, bad = (1, 4, 25.0, False, False), (3, 4, 75.0, False, True), (0, 4, 0.0, False, False)
    rows = [
        ("both", base, bad, good, (1, 2), (2, 2), (1, 2), 1, 2, "d", "  g\n", "b\t", None, 7),
        ("no tests", base, bad, good, None, (0, 0), (0, 0), 1, 2, "d", "g", "b", "n", 7),
        ("worse", base, bad, None, (2, 2), None, (2, 2), 1, None, "d", None, "b", "", None),
        ("none", base, None, None, None, None, None, None, None, None, None, None, None, None),
        ("passes", (4, 4, 100.0, True, True), bad, good, (1, 2), (2, 2), (1, 2), 1, 2, "d", "g", "b", "n", 7),
    ]
    reason = attempts.skip_reason(F.col("baseline.passed") < F.col("baseline.total"))
    done = attempts.skipped(attempts.chosen(_attempt(spark, rows), POLICIES["assert"]), reason)
    log = {r["task_id"]: r.asDict() for r in attempts.attempt_rows(done, "assert").collect()}
    of = lambda t, *c: tuple(log[t][x] for x in c)
    sources = ("selected_source", "backtracking_with_oracle_tests_source", "backtracking_with_rl_generated_tests_source")
    assert of("both", *sources) == ("generation_sample_2",) * 3 and of("both", "selected_code_full", "target_ok", "debug_prompt_chars", "entry_point") == ("  g\n", "1", "7", "")
    assert of("no tests", *sources, "note") == ("generation_sample_2", "generation_sample_2", "buggy", "n;rl_generated_backtracking_missing_or_empty_verifier")
    assert of("worse", *sources, "gen_full_suite_passed", "debug_full_suite_acc_pct", "debug_prompt_chars") == ("debug_sample_1", "buggy", "buggy", "", "0.00", "0")
    assert of("none", *sources, "note", "nonbacktracking_passed", "selected_code_full") == ("buggy", "buggy", "buggy", "", "1", "")
    assert of("passes", *sources, "note", "nonbacktracking_acc_pct", "target_ok", "debug_full_suite_passed", "debug_code_full", "selected_code_full", "debug_prompt_chars") == ("buggy", "buggy", "buggy", attempts.NO_TARGET, "100.00", "0", "", "", "b", "0")
    needs = spark.createDataFrame([(True, 0), (True, None), (True, 3), (None, 3)], "f boolean, n long").select(attempts.skip_reason(F.col("f"), F.col("n"))).collect()
    assert [r[0] for r in needs] == [attempts.NO_VERIFIER, attempts.NO_VERIFIER, "", attempts.NO_TARGET]
    empty = attempts.chosen(_attempt(spark, []), POLICIES["stdin"])
    assert attempts.attempt_rows(empty, "stdin").count() == 0


def test_attempts_compile(spark, sf, monkeypatch):
    """The JVM interprets methods of more than 8,000 bytes, so no log's projections may make such a one; attempts are
    dealt out once, in as many tasks as the results call for."""
    from mendlake.plans import attempts, file_queries

    monkeypatch.setattr(ordering, "ROWS_A_TASK", 500)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = file_queries.attempts(spark, sf)
        for layout in attempts.LAYOUTS:
            plan = attempts.attempt_rows(rows, layout)._jdf.queryExecution()
            stages = plan.debug().codegenToSeq()
            assert max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8000
            assert plan.executedPlan().toString().count("Exchange") == 1
        assert rows.rdd.getNumPartitions() == -(-queries.results(spark, sf).count() // 500)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_whole_texts_and_even_halves(spark, tmp_path):
    from mendlake.functions.code import python_repr
    from mendlake.sources import readers

    texts = ["  x\n", "\tx ", "a\"b\t'c\n\n", " ", "é\\n"]
    sinks.write_tsv(spark.createDataFrame([(t,) for t in texts], "t string"), str(tmp_path / "t"))
    assert sorted(r[0] for r in readers.tsv(spark, str(tmp_path / "t")).collect()) == sorted(texts)
    numbers = [3.125, 0.375, 12.5, 0.005, 66.66666, 2.5, 1e300, -3.125, 0.0, 99.995]
    got = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", sinks.fixed(F.col("x"), 2), sinks.fixed(F.col("x"), 1), sinks.fixed(F.col("x"), 4)).collect()
    assert [r[1] for r in got if r[0] not in (99.995, 1e300)] == [f"{x:.2f}" for x in numbers if x not in (99.995, 1e300)]
    assert [r[2] for r in got if r[0] != 1e300] == [f"{x:.1f}" for x in numbers if x != 1e300]
    assert spark.createDataFrame([("it's",), (None,), ("a\n",)], "t string").select(python_repr("t")).toPandas().iloc[:, 0].tolist() == [repr("it's"), "None", repr("a\n")]
