"""Queries that analyse or run programs. The tables hold no programs, so these are made from rows: a supplier's balance is
a constant in its program, so distinct jobs grow with the table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendlake.functions import code, nested, sandbox
from mendlake.functions.text import stdout
from mendlake.operators import evaluate, metrics
from mendlake.operators.ordering import dealt, positions
from mendlake.plans import rewarding, verifier
from mendlake.plans.queries import query
from mendlake.tables import shared_dir, table

# Programs of six kinds, with a constant c of their supplier in them, and how each fares on the suite of four asserts and
# on two calls: the second is wrong unless c is 0, the third doesn't parse, the fourth raises on an empty list, the last
# two need the helpers that only suites have.
PROGRAMS = (
    "def f(x: List[int]) -> int:\n    return sum(x) + math.floor({c}.5)",
    "def f(x):\n    return sum(x) - {c}",
    "def f(x:",
    "def f(x):\n    if not x:\n        raise ValueError(x)\n    return functools.reduce(lambda a, b: a + b, x) + {c}",
    "class Solution:\n    def f(self, x):\n        return sum(deque(x)) + {c}",
    "def f(x):\n    p, total = list_node(x), {c}\n    while p:\n        total += p.val\n        p = p.next\n    if total > 10 ** 12:\n        return None\n    return total",
)
_C = "floor(abs(s_acctbal))::BIGINT"
_PASSED = "CASE s_nationkey % 6 WHEN 0 THEN 4 WHEN 1 THEN CASE WHEN {c} = 0 THEN 4 ELSE 0 END WHEN 2 THEN 0 WHEN 3 THEN 3 ELSE 4 END"


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program and its suite for each supplier."""
    c, kind = F.floor(F.abs("s_acctbal")).cast("string"), F.col("s_nationkey") % 6
    source = F.get(F.array(*[F.replace(F.lit(p), F.lit("{c}"), c) for p in PROGRAMS]), kind)
    lines = ["def check(candidate):", "    c = ", "    assert candidate([c, 1]) == 2 * c + 1", "    assert candidate([]) == c", "    assert candidate([c]) == c + c", "    assert is_same_list(list_node([candidate([1])]), list_node([1 + c]))", ""]
    suite = F.concat(F.lit("\n".join(lines[:2])), c, F.lit("\n" + "\n".join(lines[2:])))
    entry = F.when(kind == 4, "Solution().f").when(kind != 5, "f")  # none given: it is found in the code
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", source.alias("code"), suite.alias("tests"), entry.alias("entry"), c.alias("c"))


def passed(results="results"):
    return F.size(F.filter(results, lambda r: r["ok"]))


@query(f"SELECT s_suppkey, {_PASSED.format(c=_C)} AS passed, CASE WHEN s_nationkey % 6 = 2 THEN 'candidate' WHEN {_PASSED.format(c=_C)} < 4 THEN 'assert' ELSE '' END AS error_type FROM supplier")
def sandbox_suites(spark, sf_dir):
    return sandbox.run_suites(programs(spark, sf_dir)).select("s_suppkey", passed().alias("passed"), "error_type")


@query(f"WITH p AS (SELECT s_nationkey, {_PASSED.format(c=_C)} AS passed FROM supplier) SELECT s_nationkey, sum(passed)::BIGINT AS passed, 4 * count(*) AS total, 100.0::DOUBLE * sum(passed) / (4 * count(*)) AS pct FROM p GROUP BY s_nationkey")
def suite_report(spark, sf_dir):
    counts = verifier.counted(sandbox.run_suites(programs(spark, sf_dir)), "n")
    return counts.groupBy("s_nationkey").agg(F.sum("n_passed").cast("long").alias("passed"), F.sum("n_total").cast("long").alias("total"), evaluate.pct(F.sum("n_passed"), F.sum("n_total")).alias("pct"))


@query(f"""WITH p AS (SELECT s_suppkey, s_nationkey % 6 AS kind, {_C} AS c, s_nationkey % 5 AS i FROM supplier)
    SELECT s_suppkey, i < 4 AND (kind IN (0, 4, 5) OR kind = 1 AND c = 0 OR kind = 3 AND i <> 1) AS ok,
        CASE WHEN i = 4 THEN 'index' WHEN kind = 2 THEN 'NotImplementedError' WHEN kind = 3 AND i = 1 THEN 'ValueError' ELSE '' END AS error_type FROM p""")
def single_assert(spark, sf_dir):
    """One assert of each suite by its number, which may lie outside the suite."""
    ran = sandbox.run_suites(programs(spark, sf_dir))
    one = sandbox.single_result(F.col("results"), F.col("n_asserts"), F.col("s_nationkey") % 5, F.col("error_msg"))
    return ran.select("s_suppkey", one.alias("r")).select("s_suppkey", "r.ok", "r.error_type")


FORGED = '{"results": [{"index": 0, "ok": true, "stdout": "", "error_type": "", "error_msg": ""}], "error_type": "", "error_msg": "", "total": 1}'
# Right programs that print when objects are destroyed and at exit; a wrong one that writes an outcome wherever it can;
# one that ends its interpreter.
TRICKS = (
    "class Loud:\n    def __del__(self):\n        print('gone', {c})\nkept = Loud()\ndef f(x):\n    Loud()\n    return x + {c}",
    "import atexit\natexit.register(print, {c})\ndef f(x):\n    print({c})\n    return x + {c}",
    f"import atexit, os\ndef lie():\n    for i in range(1, 20):\n        try:\n            os.write(i, b'{FORGED}')\n        except OSError:\n            pass\natexit.register(lie)\nlie()\ndef f(x):\n    return {{c}} - x - 1",
    "import os\ndef f(x):\n    os._exit(0 * {c})",
)


@query("""WITH p AS (SELECT s_suppkey, s_nationkey % 4 AS kind FROM supplier)
    SELECT s_suppkey, CASE WHEN kind IN (0, 1) THEN 2 ELSE 0 END AS passed, CASE kind WHEN 2 THEN 'exec' WHEN 3 THEN 'exec' ELSE '' END AS error_type FROM p""")
def forged_outcomes(spark, sf_dir):
    """Outcomes are the sandbox's own, whatever a program prints, leaves behind or forges."""
    c, kind = F.floor(F.abs("s_acctbal")).cast("string"), F.col("s_nationkey") % 4
    source = F.replace(F.get(F.array(*map(F.lit, TRICKS)), kind), F.lit("{c}"), c)
    tests = F.concat(F.lit("def check(candidate):\n    assert candidate(1) == 1 + "), c, F.lit("\n    assert candidate(2) == 2 + "), c)
    jobs = table(spark, sf_dir, "supplier").select("s_suppkey", source.alias("code"), tests.alias("tests"), F.lit("f").alias("entry"))
    return sandbox.run_suites(jobs).select("s_suppkey", passed().alias("passed"), "error_type")


@query("""WITH p AS (SELECT s_suppkey, s_nationkey % 3 AS kind FROM supplier)
    SELECT s_suppkey, CASE kind WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS with_helpers, CASE kind WHEN 1 THEN 2 ELSE 1 END AS bare FROM p""")
def bare_suites(spark, sf_dir):
    """Suites with and without check's other statements: an assert needs one; one raises; one is in nobody's way."""
    c, kind = F.floor(F.abs("s_acctbal")).cast("string"), F.col("s_nationkey") % 3
    helper = F.when(kind == 0, F.concat(F.lit("    n = "), c)).when(kind == 1, "    n = 1 / 0").otherwise("    n = 0")
    last = F.when(kind == 0, F.lit("n")).when(kind == 1, c).otherwise("None")
    tests = F.concat(F.lit("def check(candidate):\n"), helper, F.lit("\n    assert candidate(0) == "), c, F.lit("\n    assert candidate(0) == "), last)
    source = F.concat(F.lit("def f(x):\n    return x + "), c)
    jobs = table(spark, sf_dir, "supplier").select("s_suppkey", source.alias("code"), tests.alias("tests"), F.lit("f").alias("entry"))
    both = [sandbox.run_suites(jobs, helpers=h).select("s_suppkey", passed().alias(n)) for h, n in ((True, "with_helpers"), (False, "bare"))]
    return both[0].join(both[1], "s_suppkey")


@query(f"""WITH p AS (SELECT s_suppkey, s_nationkey, {_C} AS c FROM supplier),
    begun AS (SELECT DISTINCT s_nationkey % 6 AS kind, c FROM p WHERE s_nationkey < 12)
    SELECT s_suppkey, b.c IS NOT NULL AS kept, {_PASSED.format(c="p.c")} AS passed FROM p LEFT JOIN begun b ON b.kind = p.s_nationkey % 6 AND b.c = p.c""")
def resumed_suites(spark, sf_dir):
    """A run over some nations, then one over all with the same store: only the jobs that are missing are run."""
    jobs, store = programs(spark, sf_dir), f"{shared_dir(spark)}/outcomes-{uuid.uuid4().hex}"
    begun = sandbox.run_suites(jobs.filter("s_nationkey < 12"), store=store, commit=200).select("run").distinct()  # one name
    ran = sandbox.run_suites(jobs, store=store, commit=200).join(F.broadcast(begun.withColumn("kept", F.lit(True))), "run", "left")
    return ran.select("s_suppkey", F.coalesce("kept", F.lit(False)).alias("kept"), passed().alias("passed"))


@query("""WITH p AS (SELECT s_suppkey, s_nationkey % 3 AS kind, floor(abs(s_acctbal))::BIGINT AS c FROM supplier)
    SELECT s_suppkey, 3 AS n_asserts, CASE kind WHEN 2 THEN 0 ELSE 2 END AS correct,
        'def check(candidate):' || chr(10) || CASE kind WHEN 2 THEN '    pass' ELSE '    assert candidate(' || c || ') == ' || (2 * c) END AS tests FROM p""")
def gold_suites(spark, sf_dir):
    """Each assert of a suite on the gold program; the suite anew of those about the candidate that hold, each once."""
    c, kind = F.floor(F.abs("s_acctbal")), F.col("s_nationkey") % 3
    claim = lambda off: F.concat(F.lit("    assert candidate("), c.cast("string"), F.lit(") == "), (2 * c + off).cast("string"))
    right, wrong = claim(0), claim(1)
    third = F.when(kind == 0, right).when(kind == 1, "    assert True").otherwise(wrong)
    tests = F.concat_ws("\n", F.lit("def check(candidate):"), F.when(kind == 2, wrong).otherwise(right), wrong, third)
    source = F.lit("def f(x):\n    return 2 * x")
    jobs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), source.alias("gold"), tests.alias("tests"), F.lit("f").alias("entry"))
    return verifier.gold_suites(jobs).select(F.col("key").alias("s_suppkey"), "n_asserts", "correct", "tests")


@query(f"SELECT s_suppkey, CASE s_nationkey % 6 WHEN 0 THEN 2 WHEN 1 THEN CASE WHEN {_C} = 0 THEN 2 ELSE 0 END WHEN 3 THEN 1 WHEN 5 THEN 1 ELSE 0 END AS passed FROM supplier")
def sandbox_calls(spark, sf_dir):
    """Two calls of each function. Where no entry point is given, one result says whether the code could be loaded."""
    c = F.col("c")
    jobs = programs(spark, sf_dir).withColumns({"inputs": F.concat(F.lit("[[["), c, F.lit(", 1]], [[]]]")), "use_set": F.lit(False)})
    twice = (2 * c.cast("long") + 1).cast("string")
    jobs = jobs.withColumn("results", F.concat(F.lit("["), twice, F.lit(", "), c, F.lit("]")))
    return sandbox.run_calls(jobs).select("s_suppkey", passed("outcome").alias("passed"))


@query("SELECT s_suppkey, s_nationkey % 4 < 2 AS ok FROM supplier")
def sandbox_equality(spark, sf_dir):
    """Lists of decimals within the tolerance, sets, lists that are no sets, and decimals beyond the tolerance."""
    n, kind = (F.floor(F.abs("s_acctbal")) + 1).cast("string"), F.col("s_nationkey") % 4
    decimals = F.concat(F.lit("def f(x):\n    return [x / 3, math.sqrt("), n, F.lit(")]"))
    code = F.when(kind.isin(1, 2), F.concat(F.lit("def f(x):\n    return [x, "), n, F.lit(", x]"))).otherwise(decimals)
    root = lambda off: F.format_string("%.7f", F.sqrt(n.cast("double")) + off)
    want = F.when(kind.isin(1, 2), F.concat(F.lit("[["), n, F.lit(", 3]]"))).otherwise(F.concat(F.lit("[[1.0000001, "), F.when(kind == 0, root(F.lit(0.0))).otherwise(root(F.lit(0.001))), F.lit("]]")))
    jobs = table(spark, sf_dir, "supplier").select("s_suppkey", code.alias("code"), F.lit("f").alias("entry"), F.lit("[[3]]").alias("inputs"), want.alias("results"), (kind == 1).alias("use_set"))
    return sandbox.run_calls(jobs).select("s_suppkey", (passed("outcome") == 1).alias("ok"))


@query(f"""SELECT s_suppkey, CASE s_nationkey % 4 WHEN 0 THEN 3 WHEN 1 THEN (CASE WHEN {_C} = 0 THEN 3 ELSE 1 END) WHEN 2 THEN 0 ELSE 2 END::BIGINT AS passed, 3::BIGINT AS total,
    s_nationkey % 4 <> 2 AS target_ok, CASE s_nationkey % 4 WHEN 2 THEN 'half' ELSE {_C}::VARCHAR || chr(10) END AS target_got FROM supplier""")
def program_targets(spark, sf_dir):
    """Programs on three tests by stdin: all right, right for 0 only, exit in the middle, right but for large inputs."""
    c, kind = (F.floor(F.abs("s_acctbal"))).cast("string"), F.col("s_nationkey") % 4
    sources = ("n = int(input())\nprint(n + {c})", "n = int(input())\nprint(n * ({c} + 2) + {c} if {c} else n)", "import sys\nsys.stdout.write('half')\nsys.exit(1)", "n = int(input())\nprint(n + {c} if n < 2 else 'large')")
    code = F.get(F.array(*[F.replace(F.lit(p), F.lit("{c}"), c) for p in sources]), kind)
    tests = F.posexplode(F.array(*[F.struct(F.lit(str(i)).alias("input"), F.concat((c.cast("long") + i).cast("string"), F.lit(" \r\n")).alias("want")) for i in range(3)])).alias("test", "t")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", code.alias("code"), tests).select("s_suppkey", "code", "test", "t.input", "t.want")
    report = evaluate.program_report(sandbox.run_programs(rows), ["s_suppkey"], "test", "want")
    return report.select("s_suppkey", "passed", "total", "target_ok", "target_got")


@query("SELECT s_suppkey, s_suppkey % 3 = 0 AS ok, CASE s_suppkey % 3 WHEN 2 THEN 'NonZeroExit' ELSE '' END AS error_type, CASE s_suppkey % 3 WHEN 2 THEN 0 ELSE 200000 END + length((floor(abs(s_acctbal))::BIGINT)::VARCHAR) * (s_suppkey % 3 < 2)::INT AS chars FROM supplier")
def sandbox_programs(spark, sf_dir):
    """A program of its own for each supplier, with a long output that is compared whole."""
    c, kind = F.floor(F.abs("s_acctbal")).cast("string"), F.col("s_suppkey") % 3
    source = F.when(kind == 0, "n = input()\nprint('x' * 200000 + n)").when(kind == 1, "n = input()\nprint('y' + 'x' * 199999 + n)").otherwise("raise SystemExit(2)")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", source.alias("code"), c.alias("input"), F.concat(F.repeat(F.lit("x"), 200000), c).alias("want"))
    ran = sandbox.run_programs(rows)
    ok = F.col("ok_process") & (stdout(F.col("stdout")) == stdout(F.col("want")))
    return ran.select("s_suppkey", ok.alias("ok"), "error_type", F.length(stdout(F.col("stdout"))).alias("chars"))


@query("SELECT s_nationkey, s_suppkey, CASE WHEN s_nationkey % 6 = 5 THEN 87.5 ELSE 100.0 END::DOUBLE AS coverage_pct FROM supplier WHERE s_nationkey % 6 <> 2")
def line_coverage(spark, sf_dir):
    ran = sandbox.run_suites(programs(spark, sf_dir))
    return evaluate.line_coverage(ran.select("s_suppkey", "s_nationkey", "code", F.explode("lines").alias("line")), ["s_nationkey", "s_suppkey"], "code", "line")


@query(f"""WITH p AS (SELECT s_nationkey, CASE WHEN s_nationkey % 6 IN (4, 5) THEN 100.0 ELSE 25.0 * {_PASSED.format(c=_C)} END::DOUBLE - 50 AS err FROM supplier)
    SELECT s_nationkey, count(err) AS n_errors, round(avg(err), 6) AS me, round(avg(abs(err)), 6) AS mae, 4 * count(*) AS gold_passed FROM p GROUP BY s_nationkey""")
def verifier_pipeline(spark, sf_dir):
    gold = F.replace(F.lit(PROGRAMS[0]), F.lit("{c}"), F.col("c"))
    jobs = programs(spark, sf_dir)
    jobs = jobs.select(F.col("s_suppkey").alias("key"), "s_nationkey", gold.alias("gold"), F.when(F.col("s_nationkey") % 6 == 4, gold).otherwise(F.col("code")).alias("buggy"), "tests", F.lit("f").alias("entry"), F.lit(50.0).alias("actual_pct"))
    report = verifier.evaluated(jobs).join(jobs.select("key", "s_nationkey"), "key").groupBy("s_nationkey").agg(*metrics.error_report(F.col("error")), F.sum("gold_passed").cast("long").alias("gold_passed"))
    return report.withColumn("me", F.round("me", 6)).withColumn("mae", F.round("mae", 6))


@query(f"""SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 'pairs' ELSE 'whole_check' END AS mode, CASE WHEN s_nationkey % 2 = 0 THEN 2 ELSE 1 END AS total,
    CASE WHEN s_nationkey % 2 = 0 THEN CASE s_nationkey % 6 WHEN 2 THEN 0 ELSE 2 END ELSE CASE s_nationkey % 6 WHEN 1 THEN ({_C} = 0)::INT WHEN 3 THEN 0 ELSE 1 END END AS passed FROM supplier""")
def dataset_tests(spark, sf_dir):
    """A data set's tests: pairs of inputs and results where they can be read, else the whole check."""
    c = F.col("c")
    pairs = F.concat(F.lit("def check(candidate):\n    inputs = [[["), c, F.lit(", 1]], [[2]]]\n    results = ["), (c.cast("long") * 2 + 1).cast("string"), F.lit(", "), (c.cast("long") + 2).cast("string"), F.lit("]\n    for i, r in zip(inputs, results):\n        assert candidate(*i) == r\n"))
    jobs = programs(spark, sf_dir).withColumn("tests", F.when(F.col("s_nationkey") % 2 == 0, pairs).otherwise(F.col("tests")))
    return sandbox.run_dataset_tests(jobs).select("s_suppkey", "mode", "total", passed().alias("passed"))


@query("""WITH p AS (SELECT s_suppkey, s_nationkey % 5 AS kind, floor(abs(s_acctbal))::BIGINT % 4 AS before FROM supplier)
    SELECT s_suppkey, CASE kind WHEN 0 THEN 1000.0 * (1 - before / 4) WHEN 1 THEN 1000.0 * (0.5 - before / 4) WHEN 2 THEN 0.0 WHEN 3 THEN 1000.0 * (0 - before / 4) ELSE 0.0 END::DOUBLE AS reward FROM p""")
def batch_rewards(spark, sf_dir):
    """Completions in batches of 32: right behind reasoning, half right, unreadable, wrong, and an empty message."""
    c, kind = F.floor(F.abs("s_acctbal")), F.col("s_nationkey") % 5
    n = c.cast("string")
    fill = lambda x: F.replace(F.lit(x), F.lit("{c}"), n)
    answer = (
        F.when(kind == 0, fill("<think>```python\nnot this```</think>```python\ndef f(x):\n    return x + {c}\n```"))
        .when(kind == 1, fill("```python\ndef f(x):\n    return x + {c} if x < 2 else None\n```")).when(kind == 2, "```python\ndef f(x\n```").when(kind == 3, fill("def f(x):\n    return x - 1 - {c}")).otherwise("")
    )
    tests = F.concat(F.lit("def check(candidate):\n"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat(F.lit("    assert candidate("), i.cast("string"), F.lit(") == "), i.cast("string"), F.lit(" + "), n)), "\n"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.array(F.struct(F.lit("assistant").alias("role"), answer.alias("content"))).alias("completion"), tests.alias("tests"), F.lit("f").alias("entry"), (c % 4).alias("passed_before"), F.lit(4).alias("total"))
    batches = rewarding.batch_of(positions(rows, "s_suppkey"), 32)
    return rewarding.rewarded(batches, "repair", "batch").select("s_suppkey", "reward")


_WORDS = "regexp_extract_all(text, '[A-Za-z]+')"


def words():
    return F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)


@query(f"SELECT item_id, len({_WORDS})::INT + 1 AS n, len(list_filter({_WORDS}, lambda w: length(w) > 4))::INT AS direct FROM benchmark")
def assert_count(spark, sf_dir):
    """An assert for each word of a text, short ones nested in a condition, and one behind the check."""
    line = lambda w: F.when(F.length(w) > 4, F.concat(F.lit("    assert candidate('"), w, F.lit("')"))).otherwise(F.concat(F.lit("    if candidate:\n        assert candidate('"), w, F.lit("')")))
    tests = F.concat(F.lit("def check(candidate):\n"), F.array_join(F.transform(words(), line), "\n"), F.lit("\n    pass\nassert check\n"))
    return table(spark, sf_dir, "benchmark").select("item_id", code.count_asserts(tests).alias("n"), F.size(code.check_assert_texts(tests)).alias("direct"))


@query(f"""SELECT item_id, len(list_distinct({_WORDS}))::INT AS n_asserts, len(list_distinct(list_filter({_WORDS}, lambda w: length(w) <= 3)))::INT AS n_helpers,
    len(list_filter({_WORDS}, lambda w: length(w) > 8))::INT + 1 AS n_dropped, true AS parse_ok, 'structured_salvage' AS mode FROM benchmark""")
def salvage_suite(spark, sf_dir):
    """Asserts over two lines, helpers and junk made of a text's words; repeated ones count once."""
    check = lambda w: F.concat(F.lit("assert candidate('"), w, F.lit("') ==\\\n    1"))
    lines = lambda w: F.concat_ws("\n", check(w), F.when(F.length(w) <= 3, F.concat(F.lit("h_"), w, F.lit(" = [1]"))), F.when(F.length(w) > 8, F.concat(F.lit("open('"), w, F.lit("')"))))
    raw = F.concat(F.lit("```python\n"), F.array_join(F.transform(words(), lines), "\n"), F.lit("\n```\nassert candidate((\n"))
    got = table(spark, sf_dir, "benchmark").select("item_id", F.inline(F.array(code.salvage(F.lit(""), raw))))
    return got.select("item_id", F.size("asserts").alias("n_asserts"), F.size("helpers").alias("n_helpers"), "n_dropped", "parse_ok", "mode")


# Node types of the parts of programs in preorder, a letter each: Module, Assign, Store, Load, Name (n), Call, Constant
# (K), If, ListComp (T), comprehension (c), For, Gt, Compare (P).
_GOLD = "'MAnS' || repeat('CnL', p_size::INT) || 'K'"
_CHANGED = """'MFnSnLInLAnS' || repeat('CnL', length(p_name)::INT % 20) || 'K'
    || CASE WHEN floor(p_retailprice)::BIGINT % 2 = 0 THEN 'AnSTnLcnSnL' ELSE 'AnSCnLPnLGK' END"""


@query(f"""WITH p AS (SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN levenshtein({_GOLD}, {_CHANGED}) END AS d, length({_GOLD}) AS n FROM part)
    SELECT p_partkey, d::DOUBLE AS distance, d::DOUBLE / n AS normalised FROM p""")
def ast_distance(spark, sf_dir):
    """Nested calls against a loop, a condition, a list comprehension and a comparison; every seventh doesn't parse."""
    calls = lambda n: F.concat(F.repeat(F.lit("f("), n), F.lit("1"), F.repeat(F.lit(")"), n))
    gold = F.concat(F.lit("x = "), calls(F.col("p_size").cast("int")))
    branch = F.when(F.floor("p_retailprice") % 2 == 0, "y = [i for i in b]").otherwise("y = g(a > 2)")
    changed = F.concat(
        F.lit("for a in c:\n    if a:\n        x = "), calls(F.length("p_name") % 20), F.lit("\n    else:\n        "), branch, F.when(F.col("p_size") % 7 == 0, "(").otherwise(""),
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", gold.alias("gold"), changed.alias("code"))
    return dealt(rows, "gold", "code").select("p_partkey", F.inline(F.array(code.tree_distance("gold", "code"))))


@query("""WITH p AS (SELECT s_suppkey, s_nationkey % 5 AS kind, floor(abs(s_acctbal))::BIGINT AS c FROM supplier)
    SELECT s_suppkey, kind = 2 AS use_set,
        CASE WHEN kind < 4 THEN '[' || array_to_string(list_transform(range(0, 3), lambda i: '[' || i || ', ' || (c + i) || ']'), ', ') || ']' END AS inputs,
        CASE WHEN kind < 4 THEN '[' || array_to_string(list_transform(range(0, 3), lambda i: c + 2 * i), ', ') || ']' END AS results FROM p""")
def executed_lists(spark, sf_dir):
    """Lists of a check: literal, by comprehension, by range with a set beside, by numpy, and of two lengths."""
    c, kind = F.floor(F.abs("s_acctbal")), F.col("s_nationkey") % 5
    n = lambda i: (c + i).cast("string")
    fill = lambda x: F.replace(F.lit(made + x), F.lit("{c}"), n(0))
    plain = F.concat(
        F.lit("    inputs = [[0, "), n(0), F.lit("], [1, "), n(1), F.lit("], [2, "), n(2), F.lit("]]\n    results = ["), n(0), F.lit(", "), n(2), F.lit(", "), n(4), F.lit("]\n"),
    )
    made = "    results = [0]\n    inputs = [[i, {c} + i] for i in range(3)]\n    if candidate:\n        inputs = 'elsewhere'\n    results = "
    body = (
        F.when(kind == 0, plain).when(kind == 1, fill("[{c} + 2 * i for i in range(3)]\n")).when(kind == 2, fill("list(range({c}, {c} + 6, 2))\n    y = set(results)\n"))
        .when(kind == 3, fill("list(np.arange(3) * 2 + {c})\n")).otherwise(fill("[{c}]\n"))
    )
    tests = F.concat(F.lit("def check(candidate):\n"), body, F.lit("    for i, r in zip(inputs, results):\n        assert candidate(*i) == r\n"))
    return sandbox.run_lists(table(spark, sf_dir, "supplier").select("s_suppkey", tests.alias("tests"))).select("s_suppkey", "inputs", "results", "use_set")


@query("""WITH p AS (SELECT s_suppkey, s_nationkey % 3 AS kind, floor(abs(s_acctbal))::BIGINT AS c FROM supplier)
    SELECT s_suppkey, 5 AS n, (CASE kind WHEN 0 THEN 5 WHEN 1 THEN (c = 0)::INT * 4 + 1 ELSE 0 END)::INT AS passed FROM p""")
def oracle_calls(spark, sf_dir):
    """Programs on the lists that their checks make: right, right for the first call only, raising."""
    c, kind = F.floor(F.abs("s_acctbal")).cast("string"), F.col("s_nationkey") % 3
    sources = ("def f(i):\n    return {c} * i", "def f(i):\n    return {c} * i * i * i * 2", "def f(i):\n    raise ValueError({c})")
    tests = F.replace(F.lit("def check(candidate):\n    inputs = [[i] for i in range(5)]\n    results = [{c} * i for i in range(5)]\n"), F.lit("{c}"), c)
    source = F.replace(F.get(F.array(*map(F.lit, sources)), kind), F.lit("{c}"), c)
    jobs = table(spark, sf_dir, "supplier").select("s_suppkey", source.alias("code"), tests.alias("tests"), F.lit("f").alias("entry"))
    ran = sandbox.run_calls(sandbox.run_lists(jobs))
    return ran.select("s_suppkey", F.size("outcome").alias("n"), passed("outcome").alias("passed"))


@query(f"""WITH w AS (SELECT item_id, {_WORDS} AS w FROM benchmark)
    SELECT item_id, len(list_distinct(w))::INT AS n_asserts, 0 AS n_helpers,
        (len(list_filter(w, lambda x: length(x) <= 3)) + 1 + item_id % 2)::INT AS n_dropped, true AS parse_ok, 'check_ast_or_check_body_only' AS mode FROM w""")
def salvage_checks(spark, sf_dir):
    """A whole suite, and one that ends in the middle of an assert: what is about the candidate stays."""
    check = lambda w: F.concat(F.lit("    assert candidate(\n        '"), w, F.lit("') == 1"), F.when(F.length(w) <= 3, "\n    assert len('x')").otherwise(""))
    body = F.concat(F.lit("def check(candidate):\n    x = [1]\n"), F.array_join(F.transform(words(), check), "\n"))
    raw = F.concat(F.lit("```python\n"), body, F.when(F.col("item_id") % 2 == 1, "\n    assert candidate((1,").otherwise("\n\ndef other():\n    assert candidate(0)\n```\nThat is it."))
    got = table(spark, sf_dir, "benchmark").select("item_id", F.inline(F.array(code.salvage_checks(F.lit(""), raw))))
    return got.select("item_id", F.size("asserts").alias("n_asserts"), F.size("helpers").alias("n_helpers"), "n_dropped", "parse_ok", "mode")


@query("SELECT p_partkey, '[' || p_size || ', ' || (p_size + 1) || ']' AS inputs, '[''' || p_brand || ''']' AS results, p_size % 2 = 0 AS use_set FROM part")
def io_lists(spark, sf_dir):
    n, m = F.col("p_size").cast("string"), (F.col("p_size") + 1).cast("string")
    check = F.concat(F.lit("def check(f):\n    inputs = []\n    inputs = ["), n, F.lit(", "), m, F.lit("]\n    results = ['"), "p_brand", F.lit("']\n"), F.when(F.col("p_size") % 2 == 0, "    y = set(results)\n").otherwise(""))
    rows = dealt(table(spark, sf_dir, "part").select("p_partkey", check.alias("check")), "check")
    return rows.select("p_partkey", F.inline(F.array(code.io_lists("check"))))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 3 END AS n_cases, props AS first_input, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN (value > 50)::VARCHAR ELSE '' END AS first_output FROM events")
def any_test_cases(spark, sf_dir):
    """A case; a list under other names, with a truth value and a null among them; JSON inside JSON with a side missing."""
    props, kind = F.col("props"), F.col("event_id") % 3
    one = F.to_json(F.struct(props.alias("input"), F.col("event_type").alias("expected_output")))
    truth = F.when(F.col("value") > 50, "true").otherwise("false")
    quoted = F.to_json(F.array(props))
    quoted = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    many = F.concat(F.lit('{"private_test_cases": [{"test_input": '), quoted, F.lit(', "test_output": '), truth, F.lit('}, {"stdin": 1, "stdout": 2}, {"input": null, "output": "x"}, "[{\\"input\\": \\"a\\"}]"]}'))
    deep = F.to_json(F.struct(F.to_json(F.array(F.to_json(F.array(F.struct(props.alias("input_data")))), F.lit('[{"input": "b"}, {"output": "c"}]'))).alias("tests")))
    cases = nested.any_cases(F.when(kind == 0, one).when(kind == 1, many).otherwise(deep))
    return table(spark, sf_dir, "events").select("event_id", cases.alias("c")).select("event_id", F.size("c").alias("n_cases"), F.col("c")[0]["input"].alias("first_input"), F.lower(F.col("c")[0]["output"]).alias("first_output"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END AS n, CASE WHEN event_id % 2 = 0 THEN '' WHEN event_id % 3 = 0 THEN 'no valid tests after normalization' ELSE 'JSON must be an object with key ''tests'' containing a list' END AS error FROM events")
def normalised_tests(spark, sf_dir):
    """Generated tests as JSON: repeated pairs, sides that are no texts, and what is no list at all."""
    case = lambda a, b: F.struct(a.alias("input"), b.alias("output"))
    good = F.to_json(F.struct(F.array(case(F.col("props"), F.col("event_type")), case(F.lit("x"), F.lit("y")), case(F.col("props"), F.col("event_type"))).alias("tests")))
    bad = F.when(F.col("event_id") % 3 == 0, F.to_json(F.array(F.struct(F.col("value").alias("input"), F.lit("y").alias("output"))))).otherwise(F.col("props"))
    found = nested.normalised_tests(F.when(F.col("event_id") % 2 == 0, good).otherwise(bad))
    return table(spark, sf_dir, "events").select("event_id", found.alias("f")).select("event_id", F.size("f.tests").alias("n"), "f.error")


@query("SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN 'sorted' ELSE 'open' END AS called, n_chars % 2 = 0 AS safe FROM documents")
def safe_helpers(spark, sf_dir):
    name = F.when(F.col("n_chars") % 2 == 0, "sorted").otherwise("open")
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("called"), code.is_safe(F.concat(name, F.lit("(["), F.col("doc_id").cast("string"), F.lit("])"))).alias("safe"))
