"""Registered queries of the repair operators over the tables at hand, each with independent SQL.

A row of lineitem stands for a test result (suite: order, branch: line status, ok: not returned), orders for problems,
events for an append-only log, documents for candidates' texts, labels for flags, conversations for chats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendlake.functions import nested, records, text
from mendlake.operators import evaluate, joins, metrics, ordering, rewards, selection
from mendlake.plans import experiments, training
from mendlake.sources.readers import counted, measured
from mendlake.streaming import log
from mendlake.tables import table, written_once

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# --- suites, candidates, routes -------------------------------------------------------------------------------------


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("suite"), F.when(F.col("l_linestatus") == "F", "debug").otherwise("generation").alias("branch"), (F.col("l_suppkey") % 2 + 1).cast("int").alias("sample"),
        F.col("l_linenumber").alias("idx"), (F.col("l_returnflag") != "R").alias("ok"), (F.col("l_discount") < 0.05).alias("gen"), (F.col("l_tax") < 0.06).alias("old"),
    )


def _scored(df: DataFrame, keys: list[str], ok) -> DataFrame:
    out = df.groupBy(*keys).agg(F.count_if(ok).alias("passed"), F.count(F.lit(1)).alias("total"), F.bool_or(ok & (F.col("idx") == 1)).alias("target_ok"), F.count_if(ok & F.col("gen")).alias("gen_passed"))
    return out.withColumn("acc_pct", evaluate.pct(F.col("passed"), F.col("total"))).withColumn("problem_passed", F.col("passed") == F.col("total"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(results(spark, sf_dir), ["suite", "branch", "sample"], F.col("ok"))


R = """r AS (SELECT l_orderkey AS suite, CASE WHEN l_linestatus = 'F' THEN 'debug' ELSE 'generation' END AS branch, (l_suppkey % 2 + 1)::INT AS sample,
    l_linenumber AS idx, l_returnflag <> 'R' AS ok, l_discount < 0.05 AS gen, l_tax < 0.06 AS old FROM lineitem)"""
_measures = "count(*) FILTER (WHERE {ok}) AS passed, count(*) AS total, bool_or({ok} AND idx = 1) AS target_ok, count(*) FILTER (WHERE {ok} AND gen) AS gen_passed, 100.0::DOUBLE * count(*) FILTER (WHERE {ok}) / count(*) AS acc_pct, count(*) FILTER (WHERE {ok}) = count(*) AS problem_passed"
C = f"{R}, c AS (SELECT suite, branch, sample, {_measures.format(ok='ok')} FROM r GROUP BY ALL), b AS (SELECT suite, {_measures.format(ok='(ok AND old)')} FROM r GROUP BY ALL)"


def _best_sql(policy: str, keys: str = "suite, branch") -> str:
    return f"SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {', '.join(m + ' DESC' for m in selection.POLICIES[policy].rank)}, sample) AS n FROM c) WHERE n = 1"


@query(f"WITH {R} SELECT suite, count(*) FILTER (WHERE ok) AS passed, count(*) AS total, 100.0::DOUBLE * count(*) FILTER (WHERE ok) / count(*) AS acc_pct, bool_and(ok) AS problem_passed FROM r GROUP BY suite")
def suite_pass_rate(spark, sf_dir):
    return evaluate.suite_counts(results(spark, sf_dir), ["suite"])


@query(f"WITH {R} SELECT suite, coalesce(min(idx) FILTER (WHERE NOT ok), -1) AS target_index FROM r GROUP BY suite")
def first_failing_index(spark, sf_dir):
    return evaluate.first_failing(results(spark, sf_dir), ["suite"], "idx")


@query(f"WITH {R}, o AS (SELECT suite, 5 AS chosen, bool_or(ok) FILTER (WHERE idx = 5) AS chosen_ok, coalesce(min(idx) FILTER (WHERE NOT ok), -1) AS low FROM r GROUP BY suite) SELECT suite, CASE WHEN chosen_ok IS NULL OR chosen_ok THEN low ELSE chosen END AS target_index FROM o")
def reselected_target(spark, sf_dir):
    df = results(spark, sf_dir)
    chosen = df.groupBy("suite").agg(F.bool_or(F.when(F.col("idx") == 5, F.col("ok"))).alias("chosen_ok"))
    both = chosen.join(evaluate.first_failing(df, ["suite"], "idx"), "suite")
    return both.select("suite", evaluate.reselect_target(F.lit(5), F.col("chosen_ok"), F.col("target_index")).alias("target_index"))


@query(f"WITH {R} SELECT suite, count(*) FILTER (WHERE ok) AS correct, greatest(max(idx)::BIGINT, count(*)) AS total, greatest(0, greatest(max(idx)::BIGINT, count(*)) - count(*) FILTER (WHERE ok)) AS incorrect, count(*) FILTER (WHERE ok) / greatest(max(idx)::BIGINT, count(*))::DOUBLE AS rate FROM r GROUP BY suite")
def gold_correctness(spark, sf_dir):
    return evaluate.gold_correctness(results(spark, sf_dir), ["suite"], "idx")


def _best(policy: str):
    def run(spark, sf_dir):
        return selection.best_candidate(candidates(spark, sf_dir), ["suite", "branch"], selection.POLICIES[policy])

    return run


for _policy, _name in (("assert", "best_candidate_acc"), ("io_list", "best_candidate_passed"), ("stdin", "best_candidate_problem")):
    QUERIES[_name], ORACLES[_name] = _best(_policy), f"WITH {C} {_best_sql(_policy)}"


def _route(policy: str):
    def run(spark, sf_dir):
        best = selection.best_candidate(candidates(spark, sf_dir), ["suite", "branch"], selection.POLICIES[policy])
        both = selection.branches(best, ["suite"], ["passed", "acc_pct", "problem_passed", "target_ok"])
        return both.select("suite", selection.route(selection.POLICIES[policy]).alias("winner"))

    return run


_PIVOT = "p AS (SELECT suite, " + ", ".join(f"coalesce(max({m}::DOUBLE) FILTER (WHERE branch = '{b}'), -1) AS {b[0]}_{m}" for b in ("debug", "generation") for m in ("passed", "acc_pct", "problem_passed", "target_ok")) + " FROM best GROUP BY suite)"
_BY_FIRST = "CASE WHEN g_{m} > d_{m} THEN 'generation' WHEN d_{m} > g_{m} THEN 'debug' WHEN g_target_ok > 0 AND d_target_ok <= 0 THEN 'generation' ELSE 'debug' END"
_BY_ALL = "CASE WHEN (g_passed, g_problem_passed, g_target_ok) >= (d_passed, d_problem_passed, d_target_ok) THEN 'generation' ELSE 'debug' END"
for _policy, _name, _rule in (("assert", "route_tie_debug", _BY_FIRST.format(m="acc_pct")), ("io_list", "route_tie_debug_passed", _BY_FIRST.format(m="passed")), ("stdin", "route_tie_generation", _BY_ALL)):
    QUERIES[_name], ORACLES[_name] = _route(_policy), f"WITH {C}, best AS ({_best_sql(_policy)}), {_PIVOT} SELECT suite, {_rule} AS winner FROM p"

# --- gates, buckets, totals -----------------------------------------------------------------------------------------


def gated(spark, sf_dir):
    """The whole flow in one scan and one shuffle: candidates, best of a branch, route, three gates."""
    return experiments.gated(chosen(spark, sf_dir), ["suite"])


def chosen(spark, sf_dir):
    """The winner of each suite, a row a suite, with the buggy program's measures."""
    old = F.col("ok") & F.col("old")
    counts = ordering.by_key(results(spark, sf_dir), "suite").groupBy("suite", "branch", "sample").agg(
        F.count_if("ok").alias("passed"), F.count(F.lit(1)).alias("total"), F.bool_or(F.col("ok") & (F.col("idx") == 1)).alias("target_ok"), F.count_if(F.col("ok") & F.col("gen")).alias("gen"),
        F.count_if(old).alias("old_passed"), F.bool_or(old & (F.col("idx") == 1)).alias("old_target"), F.count_if(old & F.col("gen")).alias("old_gen"),
    )
    counts = counts.withColumn("acc_pct", evaluate.pct(F.col("passed"), F.col("total"))).withColumn("problem_passed", F.col("passed") == F.col("total"))
    extra = (F.sum("gen").alias("gen_passed"), F.sum("old_passed").alias("base_passed"), F.sum("total").alias("base_total"), F.bool_or("old_target").alias("base_target_ok"), F.sum("old_gen").alias("base_gen_passed"))
    out = experiments.selected(counts, ["suite"], selection.POLICIES["assert"], extra)
    return out.withColumn("base_acc_pct", evaluate.pct(F.col("base_passed"), F.col("base_total"))).withColumn("base_problem_passed", F.col("base_passed") == F.col("base_total"))


_CHOSEN = f"""{C}, best AS ({_best_sql("assert")}), {_PIVOT},
    w AS (SELECT suite, {_BY_FIRST.format(m="acc_pct")} AS branch FROM p),
    s AS (SELECT suite, branch || '_sample_' || sample AS source, passed, total, problem_passed, target_ok FROM best JOIN w USING (suite, branch)),
    g AS (SELECT suite, count(*) FILTER (WHERE ok AND gen) AS gen_passed FROM r GROUP BY suite),
    f AS (SELECT s.*, b.passed AS bp, b.total AS bt, b.problem_passed AS bpp, b.target_ok AS bto, b.acc_pct, g.gen_passed > b.gen_passed AS gen_keep FROM s JOIN b USING (suite) JOIN g USING (suite)),
    m AS (SELECT *, 'non_backtracking' AS mode, true AS keep FROM f UNION ALL SELECT *, 'oracle_backtracking', passed > bp FROM f UNION ALL SELECT *, 'verifier_backtracking', gen_keep FROM f),
    modes AS (SELECT suite, CASE WHEN acc_pct < 25 THEN 'Q1' WHEN acc_pct < 50 THEN 'Q2' WHEN acc_pct < 75 THEN 'Q3' ELSE 'Q4' END AS bucket, mode, CASE WHEN keep THEN passed ELSE bp END AS passed,
        CASE WHEN keep THEN total ELSE bt END AS total, CASE WHEN keep THEN problem_passed ELSE bpp END AS problem_passed, CASE WHEN keep THEN target_ok ELSE bto END AS target_ok, CASE WHEN keep THEN source ELSE 'buggy' END AS selected_source FROM m)"""
_TOTALS = """count(*) AS n_problems, sum(passed)::BIGINT AS passed, sum(total)::BIGINT AS total, 100.0::DOUBLE * sum(passed) / greatest(sum(total), 1) AS overall_pct, count(*) FILTER (WHERE problem_passed) AS n_solved,
    100.0::DOUBLE * count(*) FILTER (WHERE problem_passed) / count(*) AS solved_pct, count(*) FILTER (WHERE target_ok) AS n_fixed, 100.0::DOUBLE * count(*) FILTER (WHERE target_ok) / count(*) AS fixed_pct"""
_FROM = ", count(*) FILTER (WHERE starts_with(selected_source, 'generation')) AS from_generation, count(*) FILTER (WHERE starts_with(selected_source, 'debug')) AS from_debug"


@query(f"WITH {_CHOSEN} SELECT * FROM modes WHERE mode <> 'verifier_backtracking'")
def oracle_backtrack(spark, sf_dir):
    return gated(spark, sf_dir).filter("mode <> 'verifier_backtracking'")


@query(f"WITH {_CHOSEN} SELECT mode, bucket, {_TOTALS}{_FROM} FROM modes GROUP BY mode, bucket")
def bucketed_metrics(spark, sf_dir):
    return experiments.report(gated(spark, sf_dir), ["mode", "bucket"])


@query(f"WITH {C} SELECT o_orderpriority AS subset, branch, grouping(o_orderpriority, branch)::BIGINT AS level, {_TOTALS} FROM c JOIN orders ON o_orderkey = suite GROUP BY ROLLUP (o_orderpriority, branch)")
def rollup_global(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("suite"), F.col("o_orderpriority").alias("subset"))
    return metrics.rolled_up(candidates(spark, sf_dir).join(orders, "suite"), ["subset", "branch"], metrics.totals())


@query(f"WITH {R}, v AS (SELECT suite, count(*) FILTER (WHERE gen) AS n, count(*) FILTER (WHERE gen AND ok) AS p FROM r GROUP BY suite) SELECT suite, n > 0 AND p > 1 AS keep, CASE WHEN n = 0 THEN 'empty_verifier' ELSE '' END AS note FROM v")
def verifier_gate(spark, sf_dir):
    v = results(spark, sf_dir).groupBy("suite").agg(F.count_if("gen").alias("n"), F.count_if(F.col("gen") & F.col("ok")).alias("p"))
    return v.select("suite", F.inline(F.array(selection.verifier_gate(F.col("p"), F.lit(1), F.col("n"), selection.POLICIES["assert"]))))


@query("SELECT event_type AS user_kind, CASE WHEN trim(coalesce(props->>'$.k', '')) = '' THEN 'unknown' ELSE trim(props->>'$.k') END AS category, count(*) AS n FROM events GROUP BY ALL")
def source_histogram(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("user_kind", F.col("event_type"))
    return metrics.category_counts(df, ["user_kind"], F.get_json_object("props", "$.k"))


@query(f"""WITH {R}, e AS (SELECT o_orderpriority AS subset, 100.0::DOUBLE * count(*) FILTER (WHERE gen AND ok) / nullif(count(*) FILTER (WHERE gen), 0) - 100.0::DOUBLE * count(*) FILTER (WHERE ok) / count(*) AS err
    FROM r JOIN orders ON o_orderkey = suite GROUP BY suite, subset) SELECT subset, count(err) AS n_errors, round(coalesce(avg(err), 0), 6) AS me, round(coalesce(avg(abs(err)), 0), 6) AS mae FROM e GROUP BY subset""")
def verifier_report_mae(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("suite"), F.col("o_orderpriority").alias("subset"))
    n = F.nullif(F.count_if("gen"), F.lit(0))
    rates = results(spark, sf_dir).groupBy("suite").agg((100.0 * F.count_if(F.col("gen") & F.col("ok")) / n).alias("predicted"), evaluate.pct(F.count_if("ok"), F.count(F.lit(1))).alias("actual"))
    errors = rates.join(orders, "suite").withColumn("err", rewards.rate_error(F.col("predicted"), F.col("actual")))
    return errors.groupBy("subset").agg(*metrics.error_report(F.col("err"))).select("subset", "n_errors", F.round("me", 6).alias("me"), F.round("mae", 6).alias("mae"))


@query("SELECT source, count(*) AS n, coalesce(bool_or(toxic = 1), false) AS detected, count(toxic) AS n_labelled, round(coalesce(avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END) FILTER (WHERE toxic IS NOT NULL), 0), 6) AS detection_rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def bug_detection_rate(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels")
    hit = F.when(F.col("toxic").isNotNull(), (F.col("toxic") == 1).cast("double"))
    agg = docs.join(labels, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("detected"), F.count("toxic").alias("n_labelled"), F.round(F.coalesce(F.avg(hit), F.lit(0.0)), 6).alias("detection_rate"))
    return agg


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, max(value) AS max, round(quantile_cont(value, 0.95), 6) AS p95, round(avg((value > 0)::INT), 6) AS positive_rate FROM events GROUP BY event_type")
def batch_stats(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    out = events.groupBy("event_type").agg(*metrics.batch_stats("value")).join(metrics.exact_percentile(events, ["event_type"], "value", 0.95), "event_type")
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "max", *[F.round(c, 6).alias(c) for c in ("p95", "positive_rate")])


@query("WITH x AS (SELECT value, min(value) OVER () AS lo, max(value) OVER () AS hi FROM events WHERE value IS NOT NULL) SELECT least(19, floor((value - lo) / (hi - lo) * 20))::INT AS bin, count(*) AS n FROM x GROUP BY bin")
def histogram20(spark, sf_dir):
    return metrics.histogram(table(spark, sf_dir, "events"), "value")


@query("SELECT event_type, round(coalesce(avg(value) FILTER (WHERE event_id % 7 <> 0), 0), 6) AS mean FROM events GROUP BY event_type")
def nan_mean(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("x", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return df.groupBy("event_type").agg(F.round(metrics.nan_mean(F.col("x")), 6).alias("mean"))


# --- logs -----------------------------------------------------------------------------------------------------------

_STATE = "s AS (SELECT user_id, event_type, ts, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)"


@query(f"WITH {_STATE} SELECT event_type, count(*) AS n_keys, round(sum(value), 6) AS total FROM s GROUP BY event_type")
def resume_last_wins(spark, sf_dir):
    state = log.replay(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id")
    return state.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_keys"), F.round(F.sum("value"), 6).alias("total"))


@query(f"WITH {_STATE} SELECT * FROM s")
def streamed_resume(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    # A pattern, so that the stream takes a table that is one file as well as a folder of files.
    state = log.streamed_state(spark, f"{sf_dir}/events.parque[t]", schema, ["user_id", "event_type"], ["ts", "event_id"])
    return state.select("user_id", "event_type", "ts", "event_id", "value")


@query("SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text")
def first_wins_dedup(spark, sf_dir):
    # The digest stands for the text, so that texts aren't shuffled; the first row is a minimum, summed map-side.
    docs = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest"))
    return docs.agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).drop("digest")


@query("SELECT user_id, event_id FROM events WHERE event_type <> 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90)")
def skip_completed(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    done = events.filter("event_type = 'purchase' and value > 90").select("user_id")
    return joins.excluded(events.filter("event_type <> 'click'"), done, "user_id")[0].select("user_id", "event_id")


# --- look-ups -------------------------------------------------------------------------------------------------------


@query("""WITH k AS (SELECT doc_id, source || '|||' || lang AS a0, source AS a1, n_chars FROM documents WHERE n_chars > 400), l0 AS (SELECT a0, min(doc_id) AS v FROM k GROUP BY a0 HAVING max(n_chars) > 3000), k1 AS (SELECT a1, min(doc_id) AS v FROM k GROUP BY a1)
    SELECT d.doc_id, CASE WHEN l0.v IS NOT NULL THEN 0 WHEN k1.v IS NOT NULL THEN 1 END AS alias_level, coalesce(l0.v, k1.v) AS verifier FROM documents d LEFT JOIN l0 ON d.source || '|||' || d.lang = l0.a0 LEFT JOIN k1 ON d.source = k1.a1""")
def alias_cascade_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    # The side has texts of some length; full names are known only where one of them is long.
    side = docs.filter("n_chars > 400").withColumn("full", F.concat_ws("|||", "source", "lang"))
    known = side.groupBy("full").agg(F.max("n_chars").alias("most")).filter("most > 3000").select("full", F.lit(True).alias("known"))
    side = side.join(known, "full", "left").select(F.col("doc_id").alias("verifier"), F.when(F.col("known"), F.col("full")).alias("a0"), F.col("source").alias("a1"))
    df = docs.withColumn("row_id", F.col("doc_id"))
    found = joins.alias_lookup(df, [F.concat_ws("|||", "source", "lang"), F.col("source")], side, [F.col("a0"), F.col("a1")], ["verifier"], ["verifier"])
    return found.select("doc_id", "alias_level", "verifier")


@query("SELECT doc_id, toxic, quality, CASE WHEN l.doc_id IS NULL THEN 'missing_dataset_row' ELSE 'ok' END AS status FROM (SELECT doc_id FROM documents) d LEFT JOIN labels l USING (doc_id)")
def left_missing_status(spark, sf_dir):
    labels = joins.first_wins(table(spark, sf_dir, "labels"), ["doc_id"], "quality", "toxic")
    return joins.lookup(table(spark, sf_dir, "documents").select("doc_id"), labels, ["doc_id"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_exclusion(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_exclusion(spark, sf_dir):
    return joins.excluded(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")[0]


@query("SELECT count(*) AS n_excluded FROM (SELECT DISTINCT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents))")
def excluded_count(spark, sf_dir):
    return joins.excluded(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")[1]


@query("""WITH full_ AS (SELECT l_partkey AS k, min(l_suppkey) AS ref FROM lineitem WHERE l_returnflag = 'N' AND l_tax = 0 GROUP BY 1), bug AS (SELECT l_partkey AS k, min_by(l_suppkey, (l_quantity, l_orderkey, l_linenumber, l_suppkey)) AS ref FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
    SELECT coalesce(full_.k, bug.k) AS partkey, coalesce(full_.ref, bug.ref) AS ref, CASE WHEN full_.ref IS NOT NULL THEN 'full_pass' ELSE 'buggy_solution' END AS source FROM full_ FULL JOIN bug ON full_.k = bug.k""")
def reference_fallback(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "partkey")
    bank = rows.filter("l_returnflag = 'N' and l_tax = 0").groupBy("partkey").agg(F.min("l_suppkey").alias("ref"))
    bugs = rows.filter("l_returnflag = 'A'").groupBy("partkey").agg(F.min(F.struct("l_quantity", "l_orderkey", "l_linenumber", "l_suppkey"))["l_suppkey"].alias("ref"))
    return joins.reference_or(bank, bugs, ["partkey"], "ref", ("full_pass", "buggy_solution"))


@query("SELECT doc_id, array_to_string((SELECT list(e.doc_id ORDER BY e.doc_id) FROM (SELECT doc_id FROM documents x WHERE x.lang = d.lang AND x.n_chars > 200 AND x.doc_id <> d.doc_id ORDER BY doc_id LIMIT 2) e), ',') AS shots FROM documents d")
def fewshot_pick(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    out = joins.few_shot(docs, docs.filter("n_chars > 200").select("doc_id", "lang"), ["lang"], "doc_id", 2, "doc_id")
    return out.select("doc_id", F.nullif(F.array_join("shots", ","), F.lit("")).alias("shots"))


# --- order, caps, splits --------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 10")
def quota_cap(spark, sf_dir):
    return ordering.capped(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id"], 10, "ts", "event_id").drop("ts")


@query("SELECT event_id FROM events ORDER BY ts, event_id LIMIT 3000")
def global_cap(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy("ts", "event_id").limit(3000).select("event_id")


@query("SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS rollout, least(9, floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 4))::INT AS prompt FROM events")
def rollout_index(spark, sf_dir):
    events = ordering.occurrences(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id"], "ts", "event_id")
    n = F.col("occurrence").cast("int")
    return events.select("event_id", n.alias("rollout"), ordering.prompt_of(n, F.lit(4), F.lit(10)).alias("prompt"))


_PLAN = """f AS (SELECT event_id, user_id FROM events WHERE value < 50), o AS (SELECT *, md5('1012:' || event_id) AS h FROM f), p AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY h, event_id) <= 10 THEN 1 ELSE 2 END AS pick FROM o),
    t AS (SELECT * FROM p ORDER BY pick, h, event_id LIMIT 3000)"""


@query(f"WITH {_PLAN} SELECT event_id, user_id, pick, CASE WHEN ('0x' || substr(md5('1012:' || event_id), 1, 8))::BIGINT < {int(0.9 * 2**32)} THEN 'train' ELSE 'eval' END AS split FROM t")
def used_anti_topup(spark, sf_dir):
    failing = table(spark, sf_dir, "events").filter("value < 50").select("event_id", "user_id")
    return training.training_plan(failing, ["user_id"], "event_id")


_POS = "p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos FROM orders)"


@query(f"WITH {_POS} SELECT o_orderkey, pos FROM p WHERE pos % 4 = 3")
def shard_mod(spark, sf_dir):
    return ordering.shard(ordering.positions(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey"), 4, 3).select("o_orderkey", "pos")


@query(f"WITH {_POS} SELECT o_orderkey, pos FROM p WHERE pos >= 100 AND pos < 900")
def row_slice(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    placed = ordering.positions(orders, "o_totalprice", "o_orderkey")
    return ordering.sliced(placed, 100, 900, orders.count()).select("o_orderkey", "pos")


@query("SELECT source, ('0x' || substr(md5(source), 1, 8))::BIGINT AS name_hash, count(*) AS n FROM documents GROUP BY source")
def half_split_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", ordering.name_hash(F.col("source")).alias("name_hash"), "n")


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def except_ids(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(urgent.select("o_custkey"))


@query("""WITH a AS (SELECT doc_id, list_concat(regexp_extract_all(text, '[a-z]+'), regexp_extract_all(text, '[A-Za-z]+')) AS a FROM documents), w AS (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM a),
    f AS (SELECT doc_id, x, min(i) AS i FROM w GROUP BY ALL), j AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS words FROM f GROUP BY doc_id) SELECT doc_id, md5(coalesce(words, '')) AS words FROM documents LEFT JOIN j USING (doc_id)""")
def union_distinct_order(spark, sf_dir):
    first, second = (F.regexp_extract_all("text", F.lit(p), 0) for p in ("[a-z]+", "[A-Za-z]+"))
    words = F.array_join(F.array_union(first, second), " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(words.cast("binary")).alias("words"))


@query("SELECT c_mktsegment AS name, 'customer' AS kind, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT p_brand, 'part', count(*) FROM part GROUP BY ALL")
def union_sources(spark, sf_dir):
    one = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("name")).count().withColumn("kind", F.lit("customer"))
    two = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).count().withColumn("kind", F.lit("part"))
    return one.unionByName(two, allowMissingColumns=True).withColumnRenamed("count", "n")


# --- projections and texts ------------------------------------------------------------------------------------------


@query("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END, ''), nullif(source, ''), '') AS name, source || '|||' || lang || '|||' || doc_id AS row_key FROM documents")
def falsy_coalesce(spark, sf_dir):
    a = F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", text.falsy(a, F.col("source")).alias("name"), F.concat_ws("|||", "source", "lang", "doc_id").alias("row_key"))


@query("SELECT event_id, coalesce(trunc(try_cast(CASE WHEN event_id % 5 = 0 THEN event_type ELSE props->>'$.k' END AS DOUBLE)), 0)::INT AS n, try_cast(CASE WHEN event_id % 5 = 0 THEN event_type ELSE props->>'$.k' END AS DOUBLE) AS x FROM events")
def numeric_coercion(spark, sf_dir):
    raw = F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise(F.get_json_object("props", "$.k"))
    return table(spark, sf_dir, "events").select("event_id", counted(raw).alias("n"), measured(raw).alias("x"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_extract(spark, sf_dir):
    noisy = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("so "), "props", F.lit(" it is"))).otherwise(F.col("props"))
    found = nested.json_object(noisy)
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(found, "$.k", "bigint").alias("k"))


@query("SELECT event_id, 1 AS n_cases, event_type AS input, (props->>'$.k') AS output FROM events")
def typed_test_cases(spark, sf_dir):
    raw = F.to_json(F.array(F.struct(F.col("event_type").alias("input"), F.get_json_object("props", "$.k").alias("output")), F.struct(F.lit("x").alias("input"), F.lit(None).cast("string").alias("output"))))
    cases = nested.typed_cases(raw)
    return table(spark, sf_dir, "events").select("event_id", F.size(cases).alias("n_cases"), cases[0]["input"].alias("input"), cases[0]["output"].alias("output"))


_TRIM = r"regexp_replace({x}, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"


@query(f"SELECT doc_id, md5({_TRIM.format(x='text')}) AS code FROM documents")
def fence_extract(spark, sf_dir):
    wrapped = F.concat(F.lit("First:\n```python\nx = 1\n```\nThen:\n```Python\n"), "text", F.lit("\n```\nDone."))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.python_fence(wrapped).cast("binary")).alias("code"))


@query(f"SELECT doc_id, md5({_TRIM.format(x='text')}) AS answer FROM documents")
def strip_think(spark, sf_dir):
    wrapped = F.concat(F.lit("<think>let me\nsee</think> "), "text", F.lit("<THINK>again</THINK>"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.without_thinking(wrapped).cast("binary")).alias("answer"))


@query(f"""SELECT doc_id, CASE doc_id % 5 WHEN 3 THEN md5('def f(x):' || chr(10) || '    return ' || n_chars) WHEN 4 THEN md5({_TRIM.format(x='text')}) ELSE md5('print(' || n_chars || ')') END AS code FROM documents""")
def final_code(spark, sf_dir):
    n = F.col("n_chars").cast("string")
    body, k = F.concat(F.lit("print("), n, F.lit(")")), F.col("doc_id") % 5
    answer = (
        F.when(k == 0, F.concat(F.lit("<think>```python\nno\n```</think>FINAL FIX:\n```python\n"), body, F.lit("\n```\n")))
        .when(k == 1, F.concat(F.lit("maybe\n```\nold\n```\n4) FINAL FIX:\n```py\n"), body))
        .when(k == 2, F.concat(F.lit("so</think>Answer\n```\n"), body, F.lit("\n```")))
        .when(k == 3, F.concat(F.lit("It is this:\n\ndef f(x):\n    return "), n, F.lit("\n")))
        .otherwise(F.concat(F.lit("### Answer: "), "text"))
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.final_code(answer).cast("binary")).alias("code"))


@query("SELECT doc_id, md5(text) AS completion FROM documents")
def prompt_echo(spark, sf_dir):
    prompt = F.concat(F.lit("Q: "), "source", F.lit("\n"))
    said = F.when(F.col("doc_id") % 2 == 0, F.concat(prompt, "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.without_echo(said, prompt).cast("binary")).alias("completion"))


@query("SELECT doc_id, md5(CASE WHEN length(text) <= 501 THEN text ELSE left(text, 250) || chr(10) || chr(10) || '[... doc truncated: ' || length(text) || ' chars total, kept 250+251 chars ...]' || chr(10) || chr(10) || right(text, 251) END) AS clipped, md5(left(text, 500)) AS head FROM documents")
def clip_middle(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clip_middle(F.col("text"), 501, "doc").cast("binary")).alias("clipped"), F.md5(F.substring("text", 1, 500).cast("binary")).alias("head"))


@query(f"SELECT doc_id, md5({_TRIM.format(x='t')}) AS out FROM (SELECT doc_id, regexp_replace(text, '[ \\t]+(\\n)', '\\1', 'g') AS t FROM documents)")
def normalize_stdout(spark, sf_dir):
    padded = F.concat(F.lit("\n  "), F.regexp_replace("text", "\n", " \t\r\n"), F.lit(" \n\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.stdout(padded).cast("binary")).alias("out"))


@query("WITH x AS (SELECT 'def ' || lower(n_name) || '(a):' || chr(10) || '    return ' || n_nationkey AS code, n_nationkey, n_name FROM nation) SELECT n_nationkey, n_nationkey % 2 = 0 AS is_code, CASE n_nationkey % 3 WHEN 0 THEN 'given' WHEN 1 THEN CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE 'solve' END ELSE 'Solution().run' END AS entry FROM x")
def entry_points(spark, sf_dir):
    k = F.col("n_nationkey")
    plain = F.when(k % 2 == 0, F.concat(F.lit("def "), F.lower("n_name"), F.lit("(a):\n    return "), k.cast("string"))).otherwise(F.lit("return 1"))
    code = F.when(k % 3 == 2, F.concat(F.lit("class Solution:\n    x = 1\n    def run(self):\n        pass\n"))).otherwise(plain)
    entry = text.entry_point(F.when(k % 3 == 0, "given"), code)
    return table(spark, sf_dir, "nation").select("n_nationkey", text.looks_like_code(plain).alias("is_code"), entry.alias("entry"))


@query("SELECT n_nationkey, s_suppkey, levenshtein(n_name, s_name)::INT AS distance, levenshtein(n_name, s_name) / greatest(length(n_name), length(s_name), 1)::DOUBLE AS normalised FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def levenshtein_norm(spark, sf_dir):
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
    return both.select("n_nationkey", "s_suppkey", F.inline(F.array(text.distance(F.col("n_name"), F.col("s_name")))))


@query(f"WITH {C}, k AS (SELECT suite, branch, min_by(sample, (-acc_pct, NOT target_ok, sample)) AS chosen FROM c GROUP BY ALL) SELECT suite, branch, string_agg('p' || sample || '=' || passed || '/' || total || '(' || format('{{:.2f}}', acc_pct) || '%)', ';' ORDER BY sample) || ';selected_p' || any_value(chosen) AS summary, CASE WHEN bool_or(problem_passed) THEN 'solved' ELSE '' END || CASE WHEN bool_or(problem_passed) AND count(*) > 1 THEN ';' ELSE '' END || CASE WHEN count(*) > 1 THEN 'two' ELSE '' END AS note FROM c JOIN k USING (suite, branch) GROUP BY suite, branch")
def note_summary(spark, sf_dir):
    c = candidates(spark, sf_dir)
    chosen = selection.best_candidate(c, ["suite", "branch"], selection.POLICIES["assert"]).select("suite", "branch", F.col("sample").alias("chosen"))
    agg = c.join(chosen, ["suite", "branch"]).groupBy("suite", "branch").agg(
        selection.candidate_summary(F.col("passed"), F.col("total"), F.col("sample"), F.col("chosen")).alias("summary"), F.bool_or("problem_passed").alias("solved"), F.count(F.lit(1)).alias("n")
    )
    return agg.select("suite", "branch", "summary", text.notes(F.when(F.col("solved"), "solved").otherwise(""), F.when(F.col("n") > 1, "two").otherwise("")).alias("note"))


@query("SELECT conv_id, count(*)::INT AS n, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS said, max(CASE WHEN turn = 0 THEN text END) AS first FROM conversations GROUP BY conv_id")
def chat_messages(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    chats = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(rows, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("chat"))
    said = F.array_join(F.transform("chat", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return chats.select("conv_id", F.size("chat").alias("n"), F.md5(said.cast("binary")).alias("said"), nested.first_content(F.col("chat")).alias("first"))


@query("""SELECT doc_id, 2 AS n, length('### Problem' || chr(10) || CASE WHEN length(text) <= 10000 THEN text ELSE left(text, 5000) || chr(10) || chr(10) || '[... problem statement truncated: ' || length(text) || ' chars total, kept 5000+5000 chars ...]' || chr(10) || chr(10) || right(text, 5000) END
    || chr(10) || chr(10) || '### Starter code' || chr(10) || source || chr(10) || chr(10))::INT AS user_chars FROM documents""")
def prompt_lengths(spark, sf_dir):
    chat = nested.generation_messages(F.col("text"), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(chat).alias("n"), F.length(chat[1]["content"]).alias("user_chars"))


def _section_sql(title: str, x: str) -> str:
    return f"'### {title}' || chr(10) || {x} || chr(10) || chr(10)"


def _clip_sql(x: str, most: int, label: str) -> str:
    head, tail = most // 2, most - most // 2
    note = f"chr(10) || chr(10) || '[... {label} truncated: ' || length({x}) || ' chars total, kept {head}+{tail} chars ...]' || chr(10) || chr(10)"
    return f"CASE WHEN length({x}) <= {most} THEN {x} ELSE left({x}, {head}) || {note} || right({x}, {tail}) END"


def _chat_sql(*turns: tuple[str, str]) -> str:
    return "md5(" + " || chr(10) || ".join(f"'{role}:' || {x}" for role, x in turns) + ")"


_DEBUG, _PARTS = ("system", f"'{nested.DEBUG_SYSTEM}'"), (("input", "text", "Input"), ("expected", "source", "Expected"), ("got", "text", "Got"), ("stderr", "text", "Errors"))
_FEEDBACK = "doc_id % 4 || ' of 3 tests pass.' || CASE WHEN doc_id % 4 >= 3 THEN '' ELSE ' The first that fails:' || chr(10) || source END"
_PROMPTS = {
    "asserts": (_DEBUG, ("user", _section_sql("Program", "text") + " || " + _section_sql("Failing test", "source"))),
    "calls": (_DEBUG, ("user", " || ".join(_section_sql(t, x) for t, x in (("Program", "text"), ("Input", "source"), ("Expected", "'None'"), ("Got", "lang"), ("Entry point", "'(unknown)'"))))),
    "programs": (_DEBUG, ("user", " || ".join([_section_sql("Problem", _clip_sql("text", 10000, "problem statement")), _section_sql("Program", _clip_sql("text", 6000, "buggy program")), *[_section_sql(t, _clip_sql(x, text.TARGET_CHARS[n], n)) for n, x, t in _PARTS]]))),
    "repairs": (_DEBUG, ("user", _section_sql("Problem", "text")), ("assistant", "source"), ("user", _section_sql("Feedback", _FEEDBACK))),
    "suites": (("system", f"'{nested.TEST_SYSTEM}'"), ("user", "source"), ("assistant", "lang"), ("user", "text")),
    "pairs": (("system", f"'{nested.IO_TEST_SYSTEM}'"), ("user", "text")),
}


@query(f"SELECT doc_id, {', '.join(f'{_chat_sql(*turns)} AS {name}' for name, turns in _PROMPTS.items())} FROM (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source, coalesce(lang, 'None') AS lang FROM documents)")
def repair_prompts(spark, sf_dir):
    """Every chat that asks for a repair or for tests, over whole texts: a digest of its turns."""
    docs = table(spark, sf_dir, "documents").select("doc_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "source")], F.coalesce("lang", F.lit("None")).alias("lang"))
    body, source, lang, null = F.col("text"), F.col("source"), F.col("lang"), F.lit(None).cast("string")
    shots, none = F.array(F.struct(source.alias("problem"), lang.alias("tests"))), F.array().cast("array<struct<problem:string,tests:string>>")
    chats = {
        "asserts": nested.assert_debug_messages(body, source),
        "calls": nested.call_debug_messages(body, source, null, lang, null),
        "programs": nested.program_debug_messages(body, body, body, source, body, body),
        "repairs": nested.self_repair_messages(body, source, nested.feedback(F.col("doc_id") % 4, F.lit(3), source)),
        "suites": nested.test_messages(body, shots),
        "pairs": nested.test_messages(body, none, io=True),
    }
    said = lambda chat: F.md5(F.array_join(F.transform(chat, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n").cast("binary"))
    return docs.select("doc_id", *[said(c).alias(n) for n, c in chats.items()])


@query("""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS given FROM documents), w AS (SELECT doc_id, given, given[: len(given) // 2] AS wanted FROM d),
    l AS (SELECT doc_id, unnest(given) AS line, generate_subscripts(given, 1) - 1 AS i, wanted FROM w)
    SELECT doc_id, i::INT AS i, md5(line) AS input, CASE WHEN i < len(wanted) THEN md5(wanted[i + 1]) ELSE '(none)' END AS output FROM l""")
def zipped_cases(spark, sf_dir):
    """Inputs (bytes) paired by place with a list of outputs half as long, and a default beyond it."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    docs = table(spark, sf_dir, "documents").select("doc_id", lines.alias("given")).withColumn("wanted", F.transform(F.slice("given", F.lit(1), F.floor(F.size("given") / 2).cast("int")), lambda x: F.md5(x.cast("binary"))))
    rows = docs.select("doc_id", "wanted", F.posexplode(F.transform("given", lambda x: x.cast("binary"))).alias("i", "line"))
    return rows.select("doc_id", "i", F.md5(nested.as_text(F.col("line")).cast("binary")).alias("input"), nested.zipped(F.col("i"), F.col("wanted"), "(none)").alias("output"))


@query("""SELECT conv_id, count(*)::INT AS n, (sum(length('{"role": ' || coalesce(to_json(role), 'null') || ', "content": ' || coalesce(to_json(text), 'null') || '}')) + 2 * count(*))::INT AS chars
    FROM conversations GROUP BY conv_id""")
def prompt_json_chars(spark, sf_dir):
    """What a log calls the length of a chat's prompt."""
    message = F.struct("role", F.col("text").alias("content"))
    chats = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(message).alias("chat"))
    return chats.select("conv_id", F.size("chat").alias("n"), nested.prompt_chars(F.col("chat")).alias("chars"))


@query(r"""SELECT doc_id, md5(CASE WHEN length(text) > 6000 THEN regexp_replace(left(text, 6000), '[ \t\n\r\f\v]+$', '') || chr(10) || '# ... truncated ...' ELSE text END) AS shown FROM documents""")
def truncated_prompts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.truncated(F.col("text")).cast("binary")).alias("shown"))


@query("""SELECT CASE WHEN url LIKE '%/' THEN '' ELSE list_extract(string_split(url, '/'), -1) END AS name, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1""")
def page_names(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("name", text.basename(F.col("url")))
    return pages.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page"))


# --- rewards and reports --------------------------------------------------------------------------------------------


@query(f"""WITH {R}, s AS (SELECT suite, count(*) FILTER (WHERE ok AND old) AS p0, count(*) FILTER (WHERE ok) AS p1, count(*) AS n FROM r GROUP BY suite)
    SELECT suite, CASE WHEN suite % 9 = 0 THEN 0 ELSE 1000.0::DOUBLE * (p1 / n::DOUBLE - p0 / n::DOUBLE) END AS reward, CASE WHEN n > p0 THEN greatest(0, p1 - p0) / (n - p0)::DOUBLE ELSE 0 END AS frac_improve, CASE WHEN p0 > 0 THEN greatest(0, p0 - p1) / p0::DOUBLE ELSE 0 END AS frac_regress,
    CASE WHEN n > p0 THEN greatest(0, p1 - p0) / (n - p0)::DOUBLE ELSE 0 END - CASE WHEN p0 > 0 THEN greatest(0, p0 - p1) / p0::DOUBLE ELSE 0 END AS signed FROM s""")
def reward_passrate(spark, sf_dir):
    s = results(spark, sf_dir).groupBy("suite").agg(F.count_if(F.col("ok") & F.col("old")).alias("p0"), F.count_if("ok").alias("p1"), F.count(F.lit(1)).alias("n"))
    p0, p1, n = F.col("p0"), F.col("p1"), F.col("n")
    return s.select("suite", rewards.repair_reward(F.col("suite") % 9 != 0, p0, p1, n).alias("reward"), F.inline(F.array(rewards.improvement(p0, p1, n))))


@query("""WITH s AS (SELECT l_suppkey AS k, count(*) AS n, count(*) FILTER (WHERE l_returnflag <> 'R') AS c FROM lineitem GROUP BY 1)
    SELECT k, CASE WHEN k % 11 = 0 THEN -200.0 WHEN n = 0 THEN -200.0 WHEN k % 7 = 0 THEN -200.0 WHEN n < 10 THEN 0.0 ELSE 1000.0::DOUBLE * (c / greatest(n, 1)::DOUBLE) + 20.0::DOUBLE * least(c, 10) END::DOUBLE AS reward,
    CASE WHEN k % 11 = 0 THEN 'invalid' WHEN n = 0 THEN 'zero_asserts' WHEN k % 7 = 0 THEN 'not_wellformed' WHEN n < 10 THEN 'too_few_asserts' ELSE 'scored' END AS reason FROM s""")
def reward_testgen(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") != "R").alias("c"))
    k, n, c = F.col("k"), F.col("n"), F.col("c")
    return s.select("k", F.inline(F.array(rewards.test_reward(k % 11 != 0, n, k % 7 != 0, c, n))))


@query(f"""WITH {_CHOSEN}, e AS (SELECT * FROM (VALUES {", ".join(f"('{x.name}', '{x.kind}', '{x.verifier}')" for x in experiments.EXPERIMENTS)}) v(experiment, kind, verifier))
    SELECT experiment, {", ".join(f"100.0::DOUBLE * sum(passed) FILTER (WHERE bucket = '{q}') / sum(total) FILTER (WHERE bucket = '{q}') AS {q}" for q in ("Q1", "Q2", "Q3", "Q4"))}, 100.0::DOUBLE * sum(passed) / sum(total) AS overall
    FROM e JOIN modes ON mode = CASE verifier WHEN 'none' THEN 'non_backtracking' WHEN 'gold' THEN 'oracle_backtracking' ELSE 'verifier_backtracking' END
        AND (kind = 'routed' OR starts_with(selected_source, kind) OR selected_source = 'buggy') GROUP BY experiment""")
def main_table_pivot(spark, sf_dir):
    return report_rows(gated(spark, sf_dir), spark)


def report_rows(by_mode: DataFrame, spark: SparkSession) -> DataFrame:
    """A row for each experiment, buckets as columns (null where a bucket is empty)."""
    mode = F.when(F.col("verifier") == "none", "non_backtracking").when(F.col("verifier") == "gold", "oracle_backtracking").otherwise("verifier_backtracking")
    mine = (F.col("kind") == "routed") | F.col("selected_source").startswith(F.col("kind")) | (F.col("selected_source") == "buggy")
    sums = by_mode.groupBy("mode", "bucket", "selected_source").agg(F.sum("passed").alias("passed"), F.sum("total").alias("total"))
    rows = sums.join(F.broadcast(experiments.dimension(spark).withColumn("mode", mode)), "mode").filter(mine)  # nine rows
    cell = lambda q: 100.0 * F.sum(F.when(q, F.col("passed"))) / F.sum(F.when(q, F.col("total")))
    return rows.groupBy("experiment").agg(*[cell(F.col("bucket") == q).alias(q) for q in ("Q1", "Q2", "Q3", "Q4")], cell(F.lit(True)).alias("overall"))


@query(f"WITH {R}, a AS (SELECT branch, count(*) FILTER (WHERE ok) AS passed FROM r GROUP BY branch) SELECT e.experiment, a.* FROM a, (VALUES {', '.join(f'({chr(39)}{x.name}{chr(39)})' for x in experiments.EXPERIMENTS)}) e(experiment)")
def experiment_cross(spark, sf_dir):
    agg = results(spark, sf_dir).groupBy("branch").agg(F.count_if("ok").alias("passed"))
    return joins.with_experiments(agg, experiments.dimension(spark).select("experiment"))


# --- more rules on records ------------------------------------------------------------------------------------------


@query(f"WITH {R}, x AS (SELECT suite, list(idx ORDER BY idx) FILTER (WHERE NOT ok) AS bad FROM r GROUP BY suite) SELECT suite, coalesce(bad[(('0x' || substr(md5('1012:' || suite), 1, 8))::BIGINT % greatest(len(bad), 1) + 1)], -1)::INT AS target FROM x")
def random_target(spark, sf_dir):
    bad = results(spark, sf_dir).groupBy("suite").agg(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("idx")))).alias("bad"))
    return bad.select("suite", F.coalesce(selection.random_pick(F.col("bad"), F.col("suite"), 1012), F.lit(-1)).cast("int").alias("target"))


@query(f"WITH {R}, x AS (SELECT suite, list(DISTINCT 'assert candidate(' || idx || ')') FILTER (WHERE ok) AS good FROM r GROUP BY suite) SELECT suite, coalesce(array_to_string(list_sort(good), ';'), '') AS kept FROM x")
def gold_asserts(spark, sf_dir):
    rows = results(spark, sf_dir).groupBy("suite").agg(F.collect_list(F.struct("idx", "ok")).alias("l"))
    asserts = F.transform("l", lambda x: F.concat(F.lit("assert candidate("), x["idx"].cast("string"), F.lit(")")))
    return rows.select("suite", F.array_join(F.array_sort(records.gold_asserts(asserts, F.transform("l", lambda x: x["ok"]))), ";").alias("kept"))


@query("SELECT doc_id, CASE WHEN length(text) + length(source) + 1 <= 1500 THEN length(text) + length(source) + 1 ELSE length(text) END::INT AS chars FROM documents WHERE length(text) <= 1500")
def prompt_gate(spark, sf_dir):
    prompt = records.fitting_prompt(F.concat_ws("\n", "source", "text"), F.col("text"), 1500)
    return table(spark, sf_dir, "documents").select("doc_id", F.length(prompt).alias("chars")).filter("chars is not null")


@query("""WITH a AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '[^ ]+'), lambda w: length(w))[3:] AS a FROM conversations)
    SELECT conv_id, turn, array_to_string(CASE WHEN list_contains(a, 9) THEN a[len(a) - list_position(list_reverse(a), 9) + 2:] ELSE a END, ',') AS made FROM a""")
def token_slice(spark, sf_dir):
    """A turn's word lengths as its tokens: the prompt is two of them, and 9 ends the reasoning."""
    tokens = F.transform(F.regexp_extract_all("text", F.lit("[^ ]+"), 0), lambda w: F.length(w).cast("long"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(records.generated_tokens(tokens, F.lit(2), 9).cast("array<string>"), ",").alias("made"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'Africa (0)' ELSE r_name END AS region, CASE WHEN n_nationkey % 4 = 0 THEN '__missing_task_id_' || n_nationkey ELSE n_name END AS task_id, r_name || '::' || n_name || '::' || n_regionkey || '::' || (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) AS bug_uid FROM nation JOIN region ON r_regionkey = n_regionkey")
def record_ids(spark, sf_dir):
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    n = ordering.occurrence(["n_regionkey"], "n_nationkey")
    africa = table(spark, sf_dir, "region").filter("r_regionkey = 0").select(F.col("r_name").alias("zero"))
    named = F.when(F.col("r_name") == F.col("zero"), records.named(F.lit("zero"), {"zero": "Africa (0)"})).otherwise(records.named(F.col("r_name"), {"": "?"}))
    both = both.join(F.broadcast(africa))  # one row
    return both.select("n_nationkey", named.alias("region"), records.or_missing_id(F.when(F.col("n_nationkey") % 4 == 0, F.lit(" ")).otherwise(F.col("n_name")), F.col("n_nationkey")).alias("task_id"), records.bug_uid(F.col("r_name"), F.col("n_name"), F.col("n_regionkey"), n).alias("bug_uid"))


@query("SELECT doc_id, length(CASE WHEN length(text) <= 500 THEN text ELSE left(text, 250) || chr(10) || chr(10) || '[... question_title truncated: ' || length(text) || ' chars total, kept 250+250 chars ...]' || chr(10) || chr(10) || right(text, 250) END)::INT AS title, length(source)::INT AS platform FROM documents")
def compact_problem(spark, sf_dir):
    c = records.compact({"question_title": F.col("text"), "platform": F.col("source")}, records.PROBLEM_CHARS)
    return table(spark, sf_dir, "documents").select("doc_id", c.alias("c")).select("doc_id", F.length("c.question_title").alias("title"), F.length("c.platform").alias("platform"))


@query("SELECT item_id, CASE WHEN ('0x' || substr(md5('1012:' || item_id), 1, 8))::BIGINT < " + str(int(0.9 * 2**32)) + " THEN 'train' ELSE 'eval' END AS split FROM benchmark WHERE length(trim(text)) > 0 AND item_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def test_generation_plan(spark, sf_dir):
    excluded = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("item_id"))
    return training.test_plan(table(spark, sf_dir, "benchmark"), excluded, "item_id", ["text"]).select("item_id", "split")


@query(f"""WITH {R}, s AS (SELECT suite, suite % 4 AS epoch, 1000.0::DOUBLE * (count(*) FILTER (WHERE ok) / count(*)::DOUBLE - count(*) FILTER (WHERE ok AND old) / count(*)::DOUBLE) AS reward FROM r GROUP BY suite)
    SELECT epoch, count(*) AS n, round(avg(reward), 6) AS mean, round(stddev_pop(reward), 6) AS std, round(max(reward), 6) AS max, round(quantile_cont(reward, 0.95), 6) AS p95, round(avg((reward > 0)::INT), 6) AS positive_rate FROM s GROUP BY epoch""")
def reward_log(spark, sf_dir):
    s = results(spark, sf_dir).groupBy("suite").agg(F.count_if(F.col("ok") & F.col("old")).alias("p0"), F.count_if("ok").alias("p1"), F.count(F.lit(1)).alias("n"))
    log_rows = s.select((F.col("suite") % 4).alias("epoch"), rewards.repair_reward(F.lit(True), F.col("p0"), F.col("p1"), F.col("n")).alias("reward"))
    out = log_rows.groupBy("epoch").agg(*metrics.batch_stats("reward")).join(metrics.exact_percentile(log_rows, ["epoch"], "reward", 0.95), "epoch")
    return out.select("epoch", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "max", "p95", "positive_rate")])


@query("SELECT event_type, string_agg(k || '=' || n, ',' ORDER BY k) AS counts FROM (SELECT event_type, CASE WHEN value < 10 THEN 'unknown' ELSE 'v' || floor(value / 50)::INT END AS k, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type")
def category_maps(spark, sf_dir):
    kind = F.when(F.col("value") < 10, F.lit("  ")).otherwise(F.concat(F.lit("v"), F.floor(F.col("value") / 50).cast("string")))
    maps = metrics.category_map(metrics.category_counts(table(spark, sf_dir, "events"), ["event_type"], kind), ["event_type"])
    entries = F.transform(F.map_entries("source_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return maps.select("event_type", F.array_join(entries, ",").alias("counts"))


@query("SELECT p_partkey, 'def f(x):' || chr(10) || '    y = ' || p_size || chr(10) || '    return y' AS program FROM part")
def program_assembly(spark, sf_dir):
    n = F.col("p_size").cast("string")
    body = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("y = "), n, F.lit("\nreturn y"))).otherwise(F.concat(F.lit("def f(x):\n    y = "), n, F.lit("\n    return y")))
    return table(spark, sf_dir, "part").select("p_partkey", text.program(F.lit("def f(x):\n"), body).alias("program"))


@query(f"WITH {R}, x AS (SELECT suite, bool_or(NOT ok) AS has_target, bool_or(ok AND idx = 1) AS target_ok, count(*) FILTER (WHERE gen) AS n FROM r GROUP BY suite) SELECT suite, CASE WHEN has_target THEN coalesce(target_ok, false)::INT ELSE 0 END AS fixed, suite % 3 <> 0 AND n > 0 AS usable FROM x")
def targets_and_suites(spark, sf_dir):
    x = results(spark, sf_dir).groupBy("suite").agg(F.bool_or(~F.col("ok")).alias("has"), F.bool_or(F.col("ok") & (F.col("idx") == 1)).alias("hit"), F.count_if("gen").alias("n"))
    return x.select("suite", selection.target_fixed(F.col("has"), F.col("hit")).alias("fixed"), selection.usable_suite(F.col("suite") % 3 != 0, F.col("n")).alias("usable"))


# --- splits, pairs, picks, reports over several sources ---------------------------------------------------------------


@query("SELECT source, count(*) AS n, count(*) // 2 AS n_dev, count(*) - count(*) // 2 AS n_test, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def half_split_rows(spark, sf_dir):
    """Every file's (source's) rows dealt to dev and test by its own permutation."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    splits = ordering.half_splits(docs.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n")))
    placed = ordering.positions(docs, "source", "doc_id")
    first = placed.groupBy("source").agg(F.min("pos").alias("_first"))
    placed = placed.join(F.broadcast(first), "source").withColumn("pos", F.col("pos") - F.col("_first"))  # a row a source
    both = placed.join(splits.withColumnRenamed("name", "source"), ["source", "pos"])
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "dev").alias("n_dev"), F.count_if(F.col("split") == "test").alias("n_test"), F.sum("n_chars").alias("chars"))


@query("WITH p AS (SELECT item_id, row_number() OVER (ORDER BY md5('1012:' || item_id), item_id) - 1 AS pos, count(*) OVER () AS n FROM benchmark) SELECT item_id, pos, CASE WHEN pos < ceil(0.9::DOUBLE * n) THEN 'train' ELSE 'eval' END AS split FROM p")
def shuffled_split(spark, sf_dir):
    return ordering.shuffled_split(table(spark, sf_dir, "benchmark").select("item_id"), "item_id", 1012, 0.1)


@query("""WITH p AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY md5('1012:' || doc_id), doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents),
    h AS (SELECT *, pos - ceil(0.9::DOUBLE * n)::BIGINT AS place FROM p) SELECT doc_id, n_chars, pos FROM h WHERE place >= 0 AND place < 64""")
def held_out_rows(spark, sf_dir):
    """The rows that a held-out evaluation takes."""
    return ordering.held_out(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", 1012, 0.1)


@query("""WITH g AS (SELECT l_linestatus AS mode, CASE WHEN l_quantity <= 10 THEN 'Q1' WHEN l_quantity <= 20 THEN 'Q2' WHEN l_quantity <= 30 THEN 'Q3' ELSE 'rest' END AS bucket, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT mode, bucket, n, row_number() OVER (ORDER BY mode = 'F', bucket = 'Q1', bucket = 'Q2', bucket = 'Q3') - 1 AS place FROM g""")
def report_order(spark, sf_dir):
    """A report's rows in an order of names of its own: O before F, what has no name in the list, then from Q3 to Q1."""
    quantity = F.col("l_quantity")
    bucket = F.when(quantity <= 10, "Q1").when(quantity <= 20, "Q2").when(quantity <= 30, "Q3").otherwise("rest")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("mode"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(ordering.in_order(F.col("mode"), ["O", "F"]), ordering.in_order(F.col("bucket"), ["rest", "Q3", "Q2", "Q1"]))
    return ordering.positions(rows.withColumn("_order", order), "_order", name="place").drop("_order")


@query(f"WITH {C} SELECT suite, branch, max(acc_pct) FILTER (WHERE sample = 1) AS one, max(acc_pct) FILTER (WHERE sample = 2) AS two FROM c GROUP BY suite, branch")
def sample_pairs(spark, sf_dir):
    pairs = ordering.sample_pairs(candidates(spark, sf_dir), ["suite", "branch"], "sample", "acc_pct")
    return pairs.select("suite", "branch", F.col("pair")[0].alias("one"), F.col("pair")[1].alias("two"))


@query("""SELECT l_partkey AS partkey, min_by(l_orderkey, (CASE l_shipinstruct WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 10000 END, l_shipinstruct, l_suppkey, l_orderkey)) AS picked
    FROM (SELECT *, l_returnflag AS l_shipinstruct FROM lineitem) GROUP BY l_partkey""")
def priority_pick(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("partkey"), "l_returnflag", F.struct("l_suppkey", "l_orderkey").alias("at"), "l_orderkey")
    return joins.priority_pick(rows, ["partkey"], "l_returnflag", ["N", "A"], "at", "l_orderkey").withColumnRenamed("l_orderkey", "picked")


@query("SELECT s_suppkey, count(*) AS n, sum(l_quantity) AS quantity FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey")
def key_fallback(spark, sf_dir):
    """Keys that one side keeps as padded text and the other as numbers."""
    lines = table(spark, sf_dir, "lineitem").groupBy(joins.key_text(F.lpad(F.col("l_suppkey").cast("string"), 8, "0")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", joins.key_text(F.col("s_suppkey")).alias("key")).join(lines, "key").drop("key")


@query("""SELECT o_orderpriority AS subset, count(DISTINCT (o_custkey, o_orderstatus)) AS n_problems, count(*) / count(DISTINCT (o_custkey, o_orderstatus))::DOUBLE AS per_problem,
    round(avg((o_orderstatus <> 'P')::INT), 6) AS wellformed_rate, round(avg(o_custkey), 6) AS avg_tests, count(*) FILTER (WHERE o_totalprice < 50000) AS n_fallback FROM orders GROUP BY o_orderpriority""")
def verifier_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumns({"wellformed": F.col("o_orderstatus") != "P", "fallback": F.col("o_totalprice") < 50000})
    out = rows.groupBy(F.col("o_orderpriority").alias("subset")).agg(*metrics.verifier_totals(["o_custkey", "o_orderstatus"], "wellformed", "o_custkey", "fallback"))
    return out.withColumn("wellformed_rate", F.round("wellformed_rate", 6)).withColumn("avg_tests", F.round("avg_tests", 6))


@query("SELECT event_id, CASE WHEN value >= 10 THEN 2 + (value > 50)::INT ELSE 1 END AS n, CASE WHEN value >= 10 THEN event_type ELSE props END AS first FROM events")
def concatenated_cases(spark, sf_dir):
    """The public, private and generated tests one after the other; another list where all three are empty."""
    case = lambda x: F.array(F.struct(x.alias("input"), F.lit("y").alias("output")))
    none, value = F.array().cast(nested.CASES), F.col("value")
    public, private, made = (F.when(value >= low, case(x)).otherwise(none) for low, x in ((10, F.col("event_type")), (10, F.lit("b")), (50.0000001, F.lit("c"))))
    cases = nested.official_cases(public, private, made, none, case(F.col("props")))
    return table(spark, sf_dir, "events").select("event_id", cases.alias("c")).select("event_id", F.size("c").alias("n"), F.col("c")[0]["input"].alias("first"))


@query(f"""WITH {_CHOSEN}, e AS (SELECT * FROM (VALUES {", ".join(f"('{x.name}', '{x.kind}', '{x.verifier}')" for x in experiments.EXPERIMENTS)}) v(experiment, kind, verifier)),
    x AS (SELECT experiment, bucket, passed, total, suite FROM e JOIN modes ON mode = CASE verifier WHEN 'none' THEN 'non_backtracking' WHEN 'gold' THEN 'oracle_backtracking' ELSE 'verifier_backtracking' END
        AND (kind = 'routed' OR starts_with(selected_source, kind) OR selected_source = 'buggy'))
    SELECT experiment, {", ".join(f"100.0::DOUBLE * sum(passed) FILTER (WHERE bucket = '{q}') / sum(total) FILTER (WHERE bucket = '{q}') AS all_{q}" for q in ("Q1", "Q2", "Q3", "Q4"))}, 100.0::DOUBLE * sum(passed) / sum(total) AS all_overall,
        100.0::DOUBLE * sum(passed) FILTER (WHERE o_totalprice < 100000) / sum(total) FILTER (WHERE o_totalprice < 100000) AS small_overall, 100.0::DOUBLE * sum(passed) FILTER (WHERE o_totalprice >= 100000) / sum(total) FILTER (WHERE o_totalprice >= 100000) AS large_overall
    FROM x JOIN orders ON o_orderkey = suite GROUP BY experiment""")
def benchmarks_table(spark, sf_dir):
    """One report over three benchmarks (all suites, those of cheap and those of dear orders); all have every experiment."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("suite"), "o_totalprice")
    size = F.when(F.col("o_totalprice") < 100000, "small").otherwise("large")
    sized = chosen(spark, sf_dir).join(orders, "suite").withColumn("size", size)  # a row a suite: its three modes come after the join
    modes = experiments.gated(sized, ["size"]).withColumn("benchmark", F.explode(F.array(F.lit("all"), "size")))
    counts = written_once(modes.groupBy("benchmark", "mode", "bucket", "selected_source").agg(F.sum("passed").alias("passed"), F.sum("total").alias("total")), "counts")  # about 200 rows
    reports = {k: report_rows(counts.filter(F.col("benchmark") == k), spark) for k in ("all", "small", "large")}
    reports |= {k: reports[k].select("experiment", "overall") for k in ("small", "large")}
    return experiments.main_table(reports, experiments.dimension(spark).select("experiment"))
