"""Syntax-tree functions and the sandbox."""

import ast
import collections
import random
import tempfile
import time

import pandas as pd
import pytest
from mendlake.functions import child, code, sandbox
from mendlake.plans import code_queries, verifier
from pyspark import TaskContext
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

GOOD = "def f(a, b):\n    print('hi')\n    return a + b\n"
SUITE = "def check(candidate):\n    x = [1, 2]\n    assert candidate(1, 2) == 3\n    assert candidate(*x) == 4\n    assert candidate('a', 1) == 1\n"


def test_asserts():
    assert code.asserts_of("def check(c):\n  if 1:\n    assert c(2)\n  assert c(1)") == ["assert c(2)", "assert c(1)"]
    assert code.asserts_of("def broken(") == [] and code.asserts_of(None) == []


@pytest.mark.parametrize(("x", "ok"), [("[1, 2]", True), ("sorted([3, 1])", True), ("open('x')", False), ("a.b", False), ("[x for x in y]", False), ("lambda: 1", False), ("1 +", False), ("x[1:2]", True), ("1 << 2", False)])
def test_safe_expression(x, ok):
    assert code.safe_expression(x) is ok


def test_recovered():
    text = "Here:\n```python\ndef check(candidate):\n  x = [1]\n  y = open('f')\n  assert candidate(\n    1) == 2\n  assert candidate(1) == 2\n  assert (broken\n  assert candidate(3)\n  assert candidate(3)\n```"
    helpers, asserts, dropped = code.recovered(text)
    assert helpers == ["x = [1]"]
    assert asserts == ["assert candidate(\n1) == 2", "assert candidate(1) == 2"] + [a for a in asserts[2:]]
    assert "y = open('f')" in dropped
    again = code.recovered(code.suite(helpers, asserts))
    assert again[0] == helpers and again[1] == asserts  # salvage is idempotent


def test_salvage(spark):
    df = spark.createDataFrame([("def check(candidate):\n    assert candidate(1)", "x\nassert candidate(2)"), ("", None)], "a string, b string")
    rows = df.select(F.inline(F.array(code.salvage("a", "b")))).collect()
    assert rows[0]["asserts"] == ["assert candidate(1)", "assert candidate(2)"] and rows[0]["mode"] == "full_parse" and rows[0]["parse_ok"]
    assert rows[1]["code"] == "def check(candidate):\n    pass" and rows[1]["mode"] == "structured_salvage"


def test_balance():
    assert code.balance("f([1, '(', \"]\"") == 2 and code.balance("a) ") == -1


def test_tree_distance(spark):
    df = spark.createDataFrame([("x = 1", "x = 1"), ("x = 1", "x = 1 + 2"), ("x = ", "x = 1")], "a string, b string")
    got = [r["distance"] for r in df.select(F.inline(F.array(code.tree_distance("a", "b")))).collect()]
    assert got[0] == 0 and got[1] > 0 and got[2] is None


def test_io_lists(spark):
    df = spark.createDataFrame([("def check(f):\n    inputs = [[1]]\n    results = [2]\n    x = set(results)",), ("def (",)], "x string")
    rows = df.select(F.inline(F.array(code.io_lists("x")))).collect()
    assert tuple(rows[0]) == ("[[1]]", "[2]", True) and tuple(rows[1])[:2] == (None, None)


def test_suites(spark):
    jobs = [
        ("good", GOOD, SUITE, "f"), ("copy", GOOD, SUITE, "f"), ("syntax", "def f(", SUITE, "f"), ("missing", "x = 1", SUITE, "f"), ("loop", "def f(a, b):\n    while True: pass", SUITE, "f"),
        ("none", GOOD, "def check(candidate):\n    pass", "f"), ("broken", GOOD, "def check(", "f"), ("cls", "class Solution:\n    def f(self, a, b):\n        return a + b", SUITE, "Solution().f"),
    ]
    jobs += [
        ("helpers", "def f(x: List[int]):\n    return list_node(sorted(x))", "def check(candidate):\n    for i in [1]:\n        assert i\n    assert is_same_list(candidate([2, 1]), list_node([1, 2]))\n    assert is_same_tree(tree_node([1, 2, None, 3]), tree_node([1, 2]))\n    assert math.inf == inf", ""),
        ("late", "def f(x): return x", "def check(candidate):\n    n = 1\n    assert candidate(n) == 2\n    n = 2\n    raise ValueError\n    assert True", "f"), ("null", None, None, None),
    ]
    df = spark.createDataFrame(jobs, "name string, code string, tests string, entry string")
    got = {r["name"]: r for r in sandbox.run_suites(df).collect()}
    assert [x["ok"] for x in got["good"]["results"]] == [True, False, False]
    assert [x["error_type"] for x in got["good"]["results"]] == ["", "", "TypeError"]
    assert got["good"]["results"] == got["copy"]["results"] and got["good"]["lines"] == [1, 2, 3]
    assert got["cls"]["results"][0]["ok"]
    assert {k: got[k]["error_type"] for k in ("syntax", "missing", "loop", "none", "broken")} == {"syntax": "candidate", "missing": "assert", "loop": "timeout", "none": "no_asserts", "broken": "tests_parse"}
    assert [x["ok"] for x in got["helpers"]["results"]] == [True] * 3 and got["helpers"]["n_asserts"] == 4 and got["helpers"]["error_type"] == "assert"
    assert [x["ok"] for x in got["late"]["results"]] == [True] and got["late"]["n_asserts"] == 2  # run after check ended, with its last n
    assert got["null"]["results"] == [] and got["null"]["error_type"] == "no_asserts"


def test_calls(spark):
    rows = [
        ("a", "def f(x):\n    return x * 0.1", "f", "[[1], [3], ['a']]", "[0.1, 0.3, 'x']", False),
        ("b", "def f(x):\n    return [2, 1]", "f", "[[1]]", "[[1, 2]]", True),
        ("c", "def f(x):\n    return 'Error: bad'", "f", "[[1]]", "['error']", False),
        ("d", "def g(x): pass", "f", "[[1], [2]]", "[1, 2]", False),
        ("e", "def f(x):\n    while True: pass", "f", "[[1]]", "[1]", False),
        ("near", "def f(x: List[int]):\n    return [math.sqrt(2), x * 1.0]", "f", "[[1], [1]]", "[[1.41421356, 1.0000011], [1.41421356, 1.0000012]]", False),
        ("big", "def f(x):\n    return len([0] * 10 ** 8)", "f", "[[1]]", "[100000000]", False),
        ("hang", "while True: pass", "f", "[[1], [2]]", "[1, 2]", False),
        ("exit", "raise SystemExit", "f", "[[1], [2]]", "[1, 2]", False),
    ]
    df = spark.createDataFrame(rows, "name string, code string, entry string, inputs string, results string, use_set boolean")
    got = {r["name"]: [x["error_type"] for x in r["outcome"]] for r in sandbox.run_calls(df).collect()}
    late = "timeout"
    assert got == {"a": ["", "", late], "b": [""], "c": [""], "d": [late, late], "e": [late], "near": ["", "fail"], "big": [late], "hang": [late, late], "exit": [late, late]}


def test_dataset_tests_and_single_results(spark):
    pairs = "def assertion(a, b, atol):\n    assert a == b\ndef check(candidate):\n    inputs = [[1], 2]\n    results = [2, 5]\n"
    rows = [("pairs", "def f(x): return 2 * x", pairs), ("whole", "def f(x): return 2 * x", "def check(candidate):\n    assert candidate(1) == 2"), ("bad", "def f(", pairs)]
    got = {r["name"]: r for r in sandbox.run_dataset_tests(spark.createDataFrame(rows, "name string, code string, tests string").withColumn("entry", F.lit("f"))).collect()}
    assert {k: (r["mode"], r["total"], [x["ok"] for x in r["results"]]) for k, r in got.items()} == {"pairs": ("pairs", 2, [True, False]), "whole": ("whole_check", 1, [True]), "bad": ("pairs", 2, [False, False])}
    one = F.array(F.struct(F.lit(0).alias("index"), F.lit(True).alias("ok"), F.lit("o").alias("stdout"), F.lit("").alias("error_type"), F.lit("").alias("error_msg")))
    pick = lambda results, i: tuple(spark.range(1).select(sandbox.single_result(results, F.lit(2), F.lit(i), F.lit("why")).alias("r")).first()["r"])
    assert pick(one, 0) == (True, "o", "", "") and pick(one, 2)[2] == "index" and pick(one, 1)[2:] == ("exec", "why")


def test_programs(spark):
    rows = [("print(int(input()) + 1)", "4"), ("import sys; sys.exit(3)", ""), ("print('x' * 3000000)", "")]
    rows += [("print(1)", None), (None, "print(1)"), ("#" * 200_000 + "\nprint(2)", "")]
    got = sandbox.run_programs(spark.createDataFrame(rows, "code string, input string")).collect()
    by = {r["code"]: r for r in got}
    assert by[rows[0][0]]["stdout"] == "5\n" and by[rows[0][0]]["ok_process"]
    assert by[rows[1][0]]["error_type"] == "NonZeroExit"
    assert len(by[rows[2][0]]["stdout"]) == 3_000_001
    assert by["print(1)"]["stdout"] == "1\n" and by[None]["stdout"] == "" and by[rows[5][0]]["stdout"] == "2\n"


def recursive_types(x):
    out = []

    def visit(node):
        out.append(type(node).__name__)
        for child in ast.iter_child_nodes(node):
            visit(child)

    visit(ast.parse(x))
    return out


def table_distance(a, b):
    rows = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return rows[-1][-1]


PROGRAMS = [
    "for i in range(3):\n    if i and f(i)[1:2]:\n        x = [j for j in g(h(i), k=2) if j]\n    else:\n        y = {1: (2, 3)}\n",
    "def f(a, *b, c=1, **d) -> int:\n    try:\n        return lambda x: x + 1\n    except (A, B) as e:\n        raise\n    finally:\n        del a\n",
    "class A(B):\n    x: int = 3\n    @p\n    async def g(self):\n        await h(f'{x!r:>3}')\n        with a as b, c: pass\n", "", "x = 1",
    "while a < b <= c:\n    match a:\n        case [1, *_] if b: break\n        case {'k': v}: continue\n",
]


def test_node_types_in_preorder():
    for x in PROGRAMS:
        assert code.node_types(x) == recursive_types(x)
    assert code.node_types("def f(") is None and code.node_types(None) == ["Module"]
    deep = "(" * 80 + "1" + ",)" * 80
    assert len(code.node_types("x = " + "-" * 1500 + "1") or [None] * 3005) == 3005  # deeper than any recursion, or refused by the parser
    assert code.node_types(deep) == recursive_types(deep)


def test_bit_parallel_distance():
    rng = random.Random(2)
    for _ in range(400):
        a, b = ([rng.choice("abcd"[: rng.randrange(1, 5)]) for _ in range(rng.randrange(0, 90))] for _ in range(2))
        assert code.edit_distance(a, b) == table_distance(a, b)
    seqs = [code.node_types(x) for x in PROGRAMS]
    assert all(code.edit_distance(a, b) == table_distance(a, b) for a in seqs for b in seqs)
    assert code.edit_distance(["x"] * 20_000, ["x"] * 9000 + ["y"] * 9000) == 11_000


def slow_asserts(text):
    """The asserts of a suite that was cut off anywhere, one try of the parser for each run of lines."""
    body = text.split("\n")[1:]
    out = []
    for i, line in enumerate(body):
        if not line.strip().startswith("assert"):
            continue
        for j in range(i + 1, len(body) + 1):
            if j > i + 1 and body[j - 1].strip().startswith("assert"):
                break
            block = "\n".join(x.strip() for x in body[i:j])
            try:
                tree = ast.parse(block)
            except SyntaxError:
                continue
            if "candidate" in block and len(tree.body) == 1:
                out.append(block)
            break
    return list(dict.fromkeys(out))


def test_salvage_of_truncated_suites():
    """1,000 suites, whole and cut off anywhere: the same asserts as by trying; whole ones by their trees."""
    rng = random.Random(6)
    for k in range(1000):
        lines = ["def check(candidate):", "    pass"]
        for i in range(rng.randrange(1, 9)):
            lines += rng.choice([
                [f"    assert candidate({i}) == {k}"], [f"    x = [{i}]"], ["    assert len('(') == 1"], [f"    assert candidate(\n        [{i},\n        2]\n    ) == 3"],
                ["    for i in range(3):", "        assert candidate(i) == i"], [f"    assert candidate('(') == \"]{i}\""], ["    # assert candidate(0)"], [f"    assert (candidate({i})\n            == 1), 'text'"],
            ])
        text = "\n".join(lines)
        asserts, dropped = code.from_check("```python\n" + text + "\n```")
        tree = next(n for n in ast.parse(text).body)
        want = [n for n in tree.body if isinstance(n, ast.Assert) and any(isinstance(m, ast.Name) and m.id == "candidate" for m in ast.walk(n))]
        if want:
            assert [ast.dump(ast.parse(a).body[0]) for a in asserts] == list(dict.fromkeys(map(ast.dump, want)))
            assert len(dropped) == len(tree.body) - len(want)
        cut = text[: rng.randrange(len(lines[0]), len(text) + 1)]
        try:
            ast.parse(cut)
        except SyntaxError:
            assert code.from_check(cut)[0] == slow_asserts(cut)


def test_salvage_checks_column(spark):
    rows = [("def check(candidate):\n    assert candidate(1)\n    y = 2", "```\ndef check(candidate):\n    assert candidate(2)\n    assert candidate(1)\n```"), (None, None), ("", "no suite"), ("def check(candidate):\n  assert candidate(é='ü') == (1,\n   2)\nassert candidate(9)", "")]
    got = spark.createDataFrame(rows, "a string, b string").select(F.inline(F.array(code.salvage_checks("a", "b")))).collect()
    assert got[0]["asserts"] == ["assert candidate(1)", "assert candidate(2)"] and got[0]["n_dropped"] == 1 and got[0]["helpers"] == []
    assert [r["code"] for r in got[1:3]] == ["def check(candidate):\n    pass"] * 2 and all(r["parse_ok"] for r in got)
    assert got[3]["asserts"] == ["assert candidate(é='ü') == (1,\n   2)"]


def test_plain_whitelist():
    assert code.safe_expression("round(sum([1, 2]))", code.PLAIN_CALLABLE) and not code.safe_expression("list_node([1])", code.PLAIN_CALLABLE)
    assert code.safe_expression("list_node([1])") and not code.safe_expression("round(1)")


def test_executed_lists(spark):
    head = "def check(candidate):\n"
    rows = [
        (0, head + "    inputs = [[1, 'a']]\n    results = [(1.5,)]\n"), (1, head + "    inputs = [[i] for i in range(2)]\n    results = [np.float64(0.5), {2, 1}]\n"), (2, head + "    inputs = np.zeros(2)\n    results = [1, 2]\n"),
        (3, head + "    inputs = [1]\n    results = []\n"), (4, head + "    inputs = [open('/etc/passwd').read() for _ in [1]][:0]\n    results = []\n"), (5, head + "    inputs = [[i] for i in missing]\n    results = [1]\n"),
        (6, "inputs = [1]\nresults = [1]\n" + head + "    pass"), (7, None), (8, "def check("), (9, head + "    inputs = [float('inf')] * 2\n    results = [[np.int32(3)], None]\n    a = set([1])"),
        (10, head + "    inputs = [1]\n    inputs = [2]\n    results = inputs\n"), (11, head + "    inputs = [object()]\n    results = [1]\n"),
    ]
    df = spark.createDataFrame(rows + rows[:2], "n int, tests string")
    got = sandbox.run_lists(df).collect()
    assert len(got) == 14
    by = {r["n"]: (r["inputs"], r["results"]) for r in got}
    none = (None, None)
    assert by == {0: ("[[1, 'a']]", "[(1.5,)]"), 1: ("[[0], [1]]", "[0.5, {1, 2}]"), 2: none, 3: none, 4: ("[]", "[]"), 5: none, 6: none, 7: none, 8: none, 9: ("[1e999, 1e999]", "[[3], None]"), 10: ("[2]", "[2]"), 11: none}
    assert [r["use_set"] for r in got if r["n"] in (0, 9)].count(True) == 1
    assert all(ast.literal_eval(x) is not None for pair in by.values() for x in pair if x)


def test_outcomes_are_the_sandboxs_own(spark):
    suite = "def check(candidate):\n    assert candidate(1) == 2\n    assert candidate(2) == 3\n"
    lie = '{"results": [{"index": 0, "ok": true, "stdout": "", "error_type": "", "error_msg": ""}] * 2, "error_type": "", "error_msg": "", "total": 2}'
    jobs = {
        "destructor": "class A:\n    def __del__(self):\n        print('x' * 10)\nkept = A()\ndef f(x):\n    A()\n    return x + 1",
        "exit handler": "import atexit\natexit.register(print, 'bye')\ndef f(x):\n    return x + 1",
        "thread": "import threading, time\nthreading.Thread(target=lambda: (time.sleep(60), print(1))).start()\ndef f(x):\n    return x + 1",
        "stdout": f"import os\nos.write(1, b'''{lie}''')\ndef f(x):\n    return 0",
        "every file": f"import os\nfor i in range(64):\n    try:\n        os.write(i, b'''{lie}''')\n    except OSError:\n        pass\ndef f(x):\n    return 0",
        "leaves": "import os\ndef f(x):\n    os._exit(0)", "exits": "def f(x):\n    raise SystemExit", "kills": "import os, signal\ndef f(x):\n    os.kill(os.getpid(), signal.SIGKILL)",
        "kills the warm one": "import os, signal\ndef f(x):\n    os.kill(os.getppid(), signal.SIGKILL)", "right": "def f(x):\n    return x + 1",
    }
    df = spark.createDataFrame([(k, v, suite) for k, v in jobs.items()], "name string, code string, tests string").withColumn("entry", F.lit("f"))
    got = {r["name"]: (sum(x["ok"] for x in r["results"]), r["error_type"]) for r in sandbox.run_suites(df.coalesce(1)).collect()}
    assert {k for k, v in got.items() if v == (2, "")} >= {"destructor", "exit handler", "thread", "right"}, got
    assert all(got[k][0] == 0 for k in ("stdout", "every file", "leaves", "exits", "kills", "kills the warm one")), got


def test_lines_outlive_the_time_limit(spark):
    job = ("def f(x):\n    y = 1\n    while x:\n        y += 1\n    return y", "def check(candidate):\n    assert candidate(1)\n", "f")
    got = sandbox.run_suites(spark.createDataFrame([job], "code string, tests string, entry string")).first()
    assert got["error_type"] == "timeout" and got["lines"] == [1, 2, 3, 4] and got["results"] == [] and got["n_asserts"] == 1


def test_suites_without_helpers(spark):
    suite = "def check(candidate):\n    n = 1 / 0\n    assert candidate(1) == 1\n    assert candidate(1) == n\n"
    df = spark.createDataFrame([("def f(x): return x", suite, "f", "own")], "code string, tests string, entry string, job string")
    with_, without = (sandbox.run_suites(df, helpers=h).first() for h in (True, False))
    assert with_["results"] == [] and [r["ok"] for r in without["results"]] == [True, False]
    assert with_["job"] == without["job"] == "own" and with_["n_asserts"] == 2


def test_a_store_is_resumed(spark, tmp_path):
    """A run that is stopped between two commits leaves whole commits; the next one starts the missing children only."""
    store = f"file://{tmp_path}/outcomes"
    df = spark.createDataFrame([(i % 40, f"def f(x):\n    return x + {i % 40}", f"def check(candidate):\n    assert candidate(1) == {1 + i % 40}") for i in range(60)], "n int, code string, tests string").withColumn("entry", F.lit("f"))
    ran, real = [], DataFrameWriter.parquet

    def stopped(self, path, *a, **k):
        ran.append(path == store)
        if sum(ran) == 3:
            raise KeyboardInterrupt
        return real(self, path, *a, **k)

    DataFrameWriter.parquet = stopped
    try:
        with pytest.raises(KeyboardInterrupt):
            sandbox.run_suites(df, store=store, commit=10)
    finally:
        DataFrameWriter.parquet = real
    before = {r["job"] for r in spark.read.parquet(store).select("job").collect()}
    assert 0 < len(before) < 40
    got = sandbox.run_suites(df, store=store, commit=10).collect()
    after = spark.read.parquet(store).select("job", "run").collect()
    assert len(got) == 60 and all(r["results"][0]["ok"] for r in got)
    assert len(after) == 40 and len({r["job"] for r in after}) == 40  # none ran twice
    assert len({r["run"] for r in after}) == 2 and sum(r["run"] == got[0]["run"] for r in after) in (len(before), 40 - len(before))
    assert sandbox.run_suites(df, store=store).count() == 60 and spark.read.parquet(store).count() == 40
    empty = sandbox.run_suites(df.limit(0), store=f"file://{tmp_path}/none")
    assert empty.count() == 0


def test_a_store_takes_few_writes(spark, tmp_path, monkeypatch):
    """Writes double, whatever the size of a commit, and the tasks that have ended before one fails are kept."""
    df = spark.range(40).select(F.col("id").cast("string").alias("code"))
    writes, real = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: writes.append(path) or real(self, path, *a, **k))
    got = sandbox._once(df, ["code"], lambda job: {"stdout": job["code"]}, {"stdout": "string"}, f"file://{tmp_path}/a", 1).collect()
    assert sorted(r["stdout"] for r in got) == sorted(str(i) for i in range(40)) and writes.count(f"file://{tmp_path}/a") == 7

    def fails(job):
        if job["code"] == "7":
            time.sleep(5)
            raise ValueError("7")
        return {"stdout": job["code"]}

    store = f"file://{tmp_path}/b"
    monkeypatch.setattr(sandbox, "JOBS_A_TASK", 2)
    with pytest.raises(Exception, match="7"):
        sandbox._once(df, ["code"], fails, {"stdout": "string"}, store, 40)
    kept = {r["stdout"] for r in spark.read.parquet(store).collect()}
    assert len(kept) > 20 and "7" not in kept
    got = sandbox._once(df, ["code"], lambda job: {"stdout": "" if job["code"] in kept else job["code"]}, {"stdout": "string"}, store, 40).collect()
    assert sorted(r["stdout"] for r in got) == sorted(str(i) for i in range(40))


def test_gold_asserts(spark):
    tests = "def check(candidate):\n    assert candidate(1) == 2\n    assert candidate(1) == 3\n    assert True\n    assert candidate(1) == 2\n    raise ValueError\n    assert candidate(2) == 4"
    rows = [("a", "def f(x): return 2 * x", tests, "f"), ("broken", "def f(x): return x", "def check(", "f"), ("null", None, None, None)]
    df = spark.createDataFrame(rows, "key string, gold string, tests string, entry string")
    each = sorted((r["index"], r["ok"]) for r in verifier.gold_asserts(df).collect())
    assert each == [(0, True), (1, False), (2, True), (3, True), (4, False)]
    got = {r["key"]: (r["n_asserts"], r["correct"], r["tests"]) for r in verifier.gold_suites(df).collect()}
    empty = "def check(candidate):\n    pass"
    assert got == {"a": (5, 3, "def check(candidate):\n    assert candidate(1) == 2"), "broken": (0, 0, empty), "null": (0, 0, empty)}


def test_outcomes_are_never_broadcast(spark, sf):
    """Long outputs pack to small files, so the size of their table says nothing."""
    rows = spark.range(40).select(F.lit("print('x' * 200000)").alias("code"), (F.col("id") % 2).cast("string").alias("input"))
    plans = [sandbox.run_programs(rows), code_queries.sandbox_programs(spark, sf)]
    assert all("BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString() for df in plans)
    assert plans[0].filter(F.length("stdout") == 200001).count() == 40


def test_program_targets_of_small_balances(spark, tmp_path):
    """The second program is right for the first input only, unless its constant is 0."""
    rows = [(1, 1, 0.5), (2, 1, -1.25), (3, 1, 2.0), (4, 5, 7.0), (5, 0, 1.0), (6, 2, 1.0), (7, 3, 1.0)]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r["s_suppkey"]: (r["passed"], r["total"]) for r in code_queries.program_targets(spark, str(tmp_path)).collect()}
    assert got == {1: (3, 3), 2: (1, 3), 3: (1, 3), 4: (1, 3), 5: (3, 3), 6: (0, 3), 7: (2, 3)}


def test_equal_programs_are_parsed_once(spark, sf, monkeypatch):
    """Equal rows share a call, and the rows of one small file are dealt to all cores."""
    seen = []
    monkeypatch.setattr(code, "node_types", lambda x: seen.append(x) or [x])
    a, b = pd.Series(["x", "x", None, "x"]), pd.Series(["y", "y", "y", "z"])
    got = code.tree_distance.func(a, b)
    assert list(got["distance"]) == [1.0] * 4 and len(seen) == 6
    monkeypatch.setattr(code, "parsed", lambda x: seen.append(x))
    assert len(code.io_lists.func(pd.Series(["u", "u", None, None]))) == 4 and len(seen) == 8
    for name in ("ast_distance", "io_lists"):
        assert getattr(code_queries, name)(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_jobs_of_a_task_grow_with_their_number(spark):
    """A core has at least eight tasks, so that it is never left with one long one, and many jobs make no more of them."""
    where = lambda job: {"stdout": str(TaskContext.get().partitionId())}
    tasks = lambda n: sandbox._once(spark.range(n).select(F.col("id").cast("string").alias("code")), ["code"], where, {"stdout": "string"}).select("stdout").distinct().count()
    cores = spark.sparkContext.defaultParallelism
    assert 1 < tasks(320) <= 10 and 8 * cores // 2 < tasks(100 * 8 * cores) <= 8 * cores


def test_children_make_no_files_and_import_nothing(spark, monkeypatch):
    """A suite's channels are in memory, of bounded size as on disk; a child copies the names that were imported before."""
    made, real = [], tempfile.TemporaryFile
    monkeypatch.setattr(sandbox.tempfile, "TemporaryFile", lambda *a, **k: made.append(k) or real(*a, **k))
    monkeypatch.setattr(sandbox, "WRITTEN", 1 << 16)
    source = "import os\ndef f(n):\n    for _ in range(n):\n        os.write(1, b'x' * 1024)\n    return n"
    tests = "def check(candidate):\n    assert candidate(10) == 10\n    assert candidate(100) == 100\n    assert os.listdir() == []\n    assert open('own', 'w').write('x') == 1"
    got = sandbox.suite_outcome({"code": source, "tests": tests, "entry": "f"})
    assert [(r["ok"], r["error_type"]) for r in got["results"]] == [(True, ""), (False, "OSError"), (True, ""), (True, "")] and not made
    assert sandbox.run_program("print(input())", "a")["stdout"] == "a\n" and len(made) == 2

    plain = child.namespace(child.SUITE_IMPORTS, "np.array", helpers=True)
    monkeypatch.setattr(child, "PREPARED", {})
    child.warm()
    one, other = (child.namespace(child.SUITE_IMPORTS, "np.array", helpers=True) for _ in range(2))
    assert set(one) == set(plain) and all(one[k] is plain[k] or one[k] == plain[k] for k in one)
    one["deque"] = None
    assert other["deque"] is collections.deque and child.namespace(child.CALL_IMPORTS, "")["hashlib"]
    monkeypatch.setattr(child, "SUITE_IMPORTS", child.SUITE_IMPORTS + "late = 1")  # not prepared: it is run
    assert child.namespace(child.SUITE_IMPORTS, "")["late"] == 1
