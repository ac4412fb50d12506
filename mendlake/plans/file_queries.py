"""Queries that write tables in the file formats of repair pipelines to the shared folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mendlake.functions.code import python_repr
from mendlake.operators import metrics
from mendlake.operators.evaluate import reselect_target
from mendlake.operators.selection import POLICIES
from mendlake.plans import attempts as wide
from mendlake.plans.options import Options, cached
from mendlake.plans.queries import _BY_FIRST, _CHOSEN, _PIVOT, _TOTALS, C, ORACLES, QUERIES, _best_sql, gated, query, results
from mendlake.operators.ordering import by_key, positions
from mendlake.sources import arrow_files, readers, sinks
from mendlake.streaming import log
from mendlake.streaming import metrics as stream_metrics
from mendlake.tables import shared_dir, table


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id::VARCHAR AS doc_id, md5(text) AS text, lang FROM documents")
def tsv_texts(spark, sf_dir):
    path = fresh(spark, "tsv")
    sinks.write_tsv(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path)
    back = readers.tsv(spark, path).na.fill("")
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"), "lang")


@query("SELECT lpad(o_orderkey::VARCHAR, 9, '0') AS task_id, o_custkey::VARCHAR AS question_id, o_totalprice AS price, o_custkey % 2 = 0 AS even FROM orders")
def tsv_inferred(spark, sf_dir):
    path = fresh(spark, "tsv")
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("task_id"), F.col("o_custkey").alias("question_id"), F.col("o_totalprice").alias("price"), (F.col("o_custkey") % 2 == 0).alias("even"))
    sinks.write_tsv(rows, path)
    return readers.tsv_with_keys(spark, path)


@query("SELECT lang AS folder, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY lang")
def folder_scan(spark, sf_dir):
    """Files of several folders in one scan, each row with the folder that it is from."""
    path = fresh(spark, "folders")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    docs.withColumn("of", F.col("lang")).write.partitionBy("of").options(sep="\t", header=True).csv(path)
    found = readers.with_source(readers.tsv(spark, f"{path}/*/*.csv"))
    folder = F.regexp_replace(readers.parent_folder(F.col("source_tsv")), "^of=", "")
    return found.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("doc_id").cast("long")).alias("ids"))


@query("SELECT event_id, user_id, event_type FROM events WHERE value >= 10")
def torn_log(spark, sf_dir):
    """A log some of whose lines are torn or followed by blank ones: what can be parsed is there, and nothing else."""
    path = fresh(spark, "log")
    events = table(spark, sf_dir, "events")
    line = F.to_json(F.struct("event_id", "user_id", "event_type"))
    torn = F.when(F.col("value") < 10, F.substring(line, F.lit(1), F.length(line) - 1 - F.col("event_id").cast("int") % 20)).when(F.col("value") > 90, F.concat(line, F.lit("\n  \n"))).otherwise(line)
    events.select(torn.alias("value")).write.text(path)
    return readers.json_lines(spark, path, events.select("event_id", "user_id", "event_type").schema)


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def json_arrays(spark, sf_dir):
    """Documents that are arrays of records, a file for each nation."""
    path = fresh(spark, "arrays")
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.to_json(F.collect_list(F.struct("c_custkey", "c_name", "c_mktsegment")), {"pretty": "true"}).alias("value"))
    rows.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.json_array(spark, f"{path}/*.txt", table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").schema)


@query("SELECT DISTINCT doc_id::VARCHAR AS task_id FROM labels WHERE toxic = 1")
def id_lists(spark, sf_dir):
    path = fresh(spark, "ids")
    ids = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.concat(F.lit(" "), F.col("doc_id").cast("string"), F.lit(" ")).alias("id"))
    ids = ids.unionByName(ids).unionByName(spark.range(1).select(F.lit(" ").alias("id")))
    ids.agg(F.to_json(F.collect_list("id")).alias("value")).write.text(path)
    return readers.id_list(spark, path)


@query("SELECT CASE WHEN n_chars < 300 THEN 'dev' ELSE 'test' END AS split, doc_id, lang FROM documents")
def split_scan(spark, sf_dir):
    """A table of two splits: all of them with some columns; each split by itself has to be there."""
    path = fresh(spark, "splits")
    docs = table(spark, sf_dir, "documents").withColumn("split", F.when(F.col("n_chars") < 300, "dev").otherwise("test"))
    docs.write.partitionBy("split").parquet(path)
    both = readers.split_of(spark, path, "dev").unionByName(readers.split_of(spark, path, "test"))
    readers.missing_ids(docs, both, "doc_id")
    return readers.all_splits(spark, path, ["doc_id", "lang"])


@query("SELECT event_type, count(*) AS n, sum(user_id)::BIGINT AS users FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE value > 50) GROUP BY event_type")
def appended_log(spark, sf_dir):
    """A log that grows by two appends, read strictly."""
    path = fresh(spark, "log")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    sinks.append_json(events, path)
    sinks.append_json(events.filter("value > 50"), path)
    found = readers.json_lines(spark, path, events.schema, strict=True)
    return found.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users"))


def attempts(spark, sf_dir):
    """Attempts at every suite: the best candidate of each branch, what a part of the tests says of it, the buggy
    program (which fails what a candidate fails and the tests that aren't `old`), target, skip rules and choices."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    old = F.col("ok") & F.col("old")
    counts = by_key(results(spark, sf_dir), "suite").groupBy("suite", "branch", "sample").agg(
        F.count_if("ok").alias("passed"), F.count(F.lit(1)).alias("total"), F.bool_or(F.col("ok") & (F.col("idx") == 1)).alias("target_ok"), F.count_if(F.col("ok") & F.col("gen")).alias("gen"),
        F.count_if("gen").alias("gen_total"), F.count_if(old).alias("old"), F.count_if(old & F.col("gen")).alias("old_gen"), F.bool_or(F.when(F.col("idx") == 1, old)).alias("hit"), F.min(F.when(~old, F.col("idx"))).alias("low"),
    )
    run = wide.evaluation(passed=F.col("passed"), total=F.col("total"), target_ok=F.col("target_ok"))
    policy = POLICIES["assert"]
    order = W.partitionBy("suite", "branch").orderBy(*[F.desc(f"run.{m}") for m in policy.rank], "sample")
    ranked = counts.withColumn("run", run).withColumn("n", F.row_number().over(order))
    best = lambda b, x: F.max(F.when((F.col("branch") == b) & (F.col("n") == 1), x))
    some = F.struct(F.col("gen").alias("passed"), F.col("gen_total").alias("total"))
    per = {f: best(b, x) for b in ("debug", "generation") for f, x in ((b, F.col("run")), (f"verifier_{b}", some), (f"{b}_sample", F.col("sample")))}
    base = {"base": F.sum("old"), "base_total": F.sum("total"), "base_gen": F.sum("old_gen"), "gen_total": F.sum("gen_total"), "hit": F.bool_or("hit"), "low": F.min("low")}
    rows = ranked.groupBy("suite").agg(*[x.alias(n) for n, x in (per | base).items()])
    target = F.coalesce(reselect_target(F.lit(1), F.col("hit"), F.col("low")), F.lit(1))
    code = lambda b: F.when(F.col(b).isNotNull(), text("def f(x):\n\treturn '", F.col(f"{b}_sample"), f"' # \"{b}\""))
    rows = rows.withColumns({
        "experiment": F.lit("routed"), "task_id": text("t/", F.col("suite")), "question_id": F.col("suite"), "bug_uid": text("b", F.col("suite")), "target_idx": target,
        "baseline": wide.evaluation(passed=F.col("base"), total=F.col("base_total")), "verifier_baseline": F.struct(F.col("base_gen").alias("passed"), F.col("gen_total").alias("total")),
        "note": wide.reselected_note(F.lit(1), target), "buggy_code": text("pass\n"), "debug_code": code("debug"), "generation_code": code("generation"),
        "debug_prompt_chars": F.col("debug.total") * 100, "debug_output_chars": F.length(code("debug")), "generation_output_chars": F.length(code("generation")),
        "entry_point": F.lit("f"), "target_input": python_repr(text("it's ", F.col("suite"))), "target_expected": python_repr(F.lit(None).cast("string")),
    })
    failing = F.col("baseline.passed") < F.col("baseline.total")
    return wide.skipped(wide.chosen(rows, policy), wide.skip_reason(failing, F.col("gen_total")))


def _attempt_log(layout: str):
    def run(spark, sf_dir):
        path = fresh(spark, "attempts")
        sinks.write_tsv(wide.attempt_rows(attempts(spark, sf_dir), layout), path)
        return readers.tsv(spark, path).na.fill("")

    run.__doc__ = f"The wide log of attempts in the columns of {layout} runs: quoted text, read back as text."
    return run


_ATTEMPTS = f"""{C}, best AS ({_best_sql("assert")}), {_PIVOT},
    e AS (SELECT suite, branch, sample, count(*) FILTER (WHERE gen) AS gen_total FROM r GROUP BY ALL),
    t AS (SELECT suite, bool_or(ok AND old) FILTER (WHERE idx = 1) AS hit, min(idx) FILTER (WHERE NOT (ok AND old)) AS low, count(*) FILTER (WHERE gen) AS gt FROM r GROUP BY suite),
    k AS (SELECT best.*, e.gen_total, 'def f(x):' || chr(10) || chr(9) || 'return ''' || best.sample || ''' # "' || best.branch || '"' AS code FROM best JOIN e USING (suite, branch, sample)),
    j AS (SELECT suite, {_BY_FIRST.format(m="acc_pct")} AS winner FROM p),
    x AS (SELECT j.suite, b.passed AS bp, b.total AS bt, b.acc_pct AS ba, b.gen_passed AS bg, t.gt, coalesce(CASE WHEN t.hit IS NULL OR t.hit THEN t.low ELSE 1 END, 1) AS idx,
        CASE WHEN b.passed = b.total THEN 'skipped_no_failing_asserts' WHEN t.gt = 0 THEN 'skipped_missing_or_empty_verifier' ELSE '' END AS reason,
        d.passed AS dp, d.total AS dt, d.acc_pct AS da, d.problem_passed AS ds, d.gen_passed AS dg, d.gen_total AS dgt, d.code AS dc,
        g.passed AS gp, g.total AS gto, g.acc_pct AS ga, g.problem_passed AS gs, g.gen_passed AS gg, g.gen_total AS ggt, g.code AS gc,
        s.passed AS sp, s.total AS st, s.acc_pct AS sa, s.problem_passed AS ss, s.target_ok AS sk, s.gen_passed AS sg, s.gen_total AS sgt, s.code AS sc, s.branch || '_sample_' || s.sample AS source
        FROM j JOIN b USING (suite) JOIN t USING (suite) LEFT JOIN k d ON d.suite = j.suite AND d.branch = 'debug' LEFT JOIN k g ON g.suite = j.suite AND g.branch = 'generation' JOIN k s ON s.suite = j.suite AND s.branch = j.winner),
    y AS (SELECT *, reason = '' AS did, reason = '' AND sp > bp AS o, reason = '' AND sg > bg AS v FROM x)"""
#: What each field of a log is in the SQL above: of rows that are attempted only, or of all.
_DID = {"debug": ("dp", "dt", "da", "ds"), "generation": ("gp", "gto", "ga", "gs"), "verifier_debug": ("dg", "dgt"), "verifier_generation": ("gg", "ggt"), "verifier_baseline": ("bg", "gt"), "verifier_selected": ("sg", "sgt")}
_KEPT = {"baseline": "false", "nonbacktracking": "did", "oracle": "o", "generated": "v"}
_FIELDS = {
    "experiment": "'routed'", "task_id": "'t/' || suite", "question_id": "suite", "bug_uid": "'b' || suite", "bug_source_model_tag": "''", "target_idx": "idx", "selected_source": "CASE WHEN did THEN source ELSE 'buggy' END",
    "oracle_source": "CASE WHEN o THEN source ELSE 'buggy' END", "generated_source": "CASE WHEN v THEN source ELSE 'buggy' END", "target_ok": "CASE WHEN did AND sk THEN 1 ELSE 0 END", "entry_point": "'f'",
    "debug_prompt_chars": "CASE WHEN did THEN coalesce(dt * 100, 0) ELSE 0 END", "generation_prompt_chars": "''", "debug_output_chars": "CASE WHEN did THEN coalesce(length(dc), 0) ELSE 0 END",
    "generation_output_chars": "CASE WHEN did THEN coalesce(length(gc), 0) ELSE 0 END", "target_input": "chr(34) || 'it' || chr(39) || 's ' || suite || chr(34)", "target_expected": "'None'", "target_got_baseline": "''", "target_got_selected": "''",
    "note": "CASE WHEN NOT did THEN reason WHEN idx <> 1 THEN 'reselected_assert_from_1_to_' || idx ELSE '' END", "debug_code": "CASE WHEN did THEN dc END", "generation_code": "CASE WHEN did THEN gc END", "selected_code": "CASE WHEN did THEN sc ELSE 'pass' || chr(10) END",
}


def _field_sql(path: str) -> str:
    field, _, m = path.partition(".")
    if not m:
        return f"coalesce(({_FIELDS[field]})::VARCHAR, '')"
    if field in _DID:
        x = f"CASE WHEN did THEN {_DID[field][wide.ALL.index(m)]} END"
    else:
        mine = {"passed": ("sp", "bp"), "total": ("st", "bt"), "acc_pct": ("sa", "ba"), "problem_passed": ("ss", "bp = bt")}[m]
        x = f"CASE WHEN {_KEPT[field]} THEN {mine[0]} ELSE {mine[1]} END"
    return f"coalesce(format('{{:.2f}}', {x}), '')" if m == "acc_pct" else f"coalesce(({x})::{'INT::' if m == 'problem_passed' else ''}VARCHAR, '')"


for _layout, _name in (("assert", "attempt_log"), ("io_list", "attempt_log_io_list"), ("stdin", "attempt_log_stdin")):
    QUERIES[_name] = _attempt_log(_layout)
    ORACLES[_name] = f"WITH {_ATTEMPTS} SELECT {', '.join(f'{_field_sql(f)} AS {c}' for c, f in wide.LAYOUTS[_layout].items())} FROM y"


@query(f"""WITH {_CHOSEN}, t AS (SELECT mode, {_TOTALS} FROM modes GROUP BY mode), k AS (SELECT mode, selected_source AS s, count(*) AS n FROM modes GROUP BY ALL)
    SELECT mode, n_problems::VARCHAR AS evaluated, passed::VARCHAR AS passed, total::VARCHAR AS total, format('{{:.4f}}', overall_pct) AS overall_pct, '{{' || string_agg('"' || s || '":' || n, ',' ORDER BY s) || '}}' AS source_counts
    FROM t JOIN k USING (mode) GROUP BY mode, n_problems, passed, total, overall_pct""")
def summary_tsv(spark, sf_dir):
    """The summary as text: four decimals, and the counts by source as a JSON map with sorted keys."""
    path = fresh(spark, "summary")
    modes = gated(spark, sf_dir)
    totals = modes.groupBy("mode").agg(*metrics.totals()).withColumnRenamed("n_problems", "evaluated")
    maps = metrics.category_map(metrics.category_counts(modes, ["mode"], F.col("selected_source")), ["mode"])
    rows = sinks.log_rows(totals.join(maps, "mode"), ["mode", "evaluated", "passed", "total", "overall_pct", "source_counts"], 4)
    sinks.write_tsv(rows, path)
    return readers.tsv(spark, path)


@query("SELECT source, count(*) AS n, 'assert' AS policy, 1012::BIGINT AS seed FROM documents GROUP BY source")
def run_record(spark, sf_dir):
    """Results beside the options of the run that made them; what is there already is read, not made again."""
    path = fresh(spark, "run")
    options = Options(experiments=("debug_none",))
    sinks.write_document(options.record(spark), f"{path}/args")
    made = lambda: table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    cached(spark, f"{path}/counts", made)
    args = readers.json_array(spark, f"{path}/args", options.record(spark).schema).select("policy", "seed")
    return cached(spark, f"{path}/counts", made).join(F.broadcast(args))  # one row



SEGMENT = 500


def segments(lines, *order: str):
    """(name, content): a log for each value of the column log, cut into segments of SEGMENT lines (text, in order) that
    don't end where lines do: the first bytes of a segment's first line stand at the end of the segment before."""
    at = positions(lines, "log", *order).withColumn("s", F.floor(F.col("pos") / SEGMENT))
    low = at.groupBy("log").agg(F.min("s").alias("low"))  # segments count from 0 in each log
    at = at.join(F.broadcast(low), "log").withColumn("s", F.col("s") - F.col("low"))
    heads = at.groupBy("log", "s").agg(F.min("pos").alias("first"))
    at = at.join(heads, ["log", "s"])
    k = F.when((F.col("pos") == F.col("first")) & (F.col("s") > 0), 1 + F.col("pos") % F.least(F.length("text"), F.lit(40))).otherwise(0).cast("int")
    whole = F.concat("text", F.lit("\n"))
    at = at.withColumn("k", k)
    pieces = at.select("log", "s", "pos", F.substring(whole, F.col("k") + 1, F.length(whole)).alias("piece")).unionByName(at.filter("k > 0").select("log", F.expr("s - 1").alias("s"), "pos", F.substring("text", F.lit(1), F.col("k")).alias("piece")))
    texts = pieces.groupBy("log", "s").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "").alias("content"))
    return texts.select(F.format_string("log=%s/segment=%d/lines.jsonl", "log", "s").alias("name"), "content")


@query("""WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_type DESC, event_id DESC) AS n FROM events WHERE value >= 5)
    SELECT user_id, event_id, round(value, 6) AS value FROM r WHERE n = 1""")
def torn_stream(spark, sf_dir):
    """Logs whose segments end within lines, some of them torn for good, as streams: the last whole record of each user."""
    events = table(spark, sf_dir, "events")
    line = F.to_json(F.struct("user_id", "event_id", "value", F.lit("é").alias("mark")))
    torn = F.when(F.col("value") < 5, F.substring(line, F.lit(1), F.length(line) - 2)).otherwise(line)
    path = fresh(spark, "segments")
    sinks.write_bytes(segments(events.select(F.col("event_type").alias("log"), "event_id", torn.alias("text")), "event_id"), path)
    schema = events.select("user_id", "event_id", "value").schema
    return log.streamed_log(spark, path, schema, ["user_id"]).select("user_id", "event_id", F.round("value", 6).alias("value"))


_BINS = ", ".join(f"sum((greatest(0, least(19, floor(value / 100 * 20))) = {i})::INT)::BIGINT" for i in range(stream_metrics.BINS))


@query(f"SELECT 3::BIGINT AS batches, count(*)::DOUBLE AS rows, round(sum(value), 3) AS sum, min(value) AS least, max(value) AS most, array_to_string([{_BINS}], ',') AS bins FROM events")
def stream_metrics_table(spark, sf_dir):
    """Scalars and bins of each of a stream's three batches, in a table; together they are those of all rows."""
    events = table(spark, sf_dir, "events").select("event_id", "value")
    path, out = fresh(spark, "events"), fresh(spark, "metrics")
    for i in range(3):
        events.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(path)
    metrics_ = stream_metrics.MetricTable(spark, out)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    seen = stream_metrics.measured(stream, "events", "value", 0.0, 100.0)
    seen.writeStream.format("noop").option("checkpointLocation", fresh(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    batches = stream_metrics.by_batch(metrics_.close())
    return batches.agg(*stream_metrics.together(batches)).select("batches", "rows", F.round("sum", 3).alias("sum"), "least", "most", F.array_join(F.transform("bins", lambda x: x.cast("string")), ",").alias("bins"))


@query("SELECT conv_id, turn, role, md5(text) AS text FROM conversations")
def arrow_files_scan(spark, sf_dir):
    """Conversations as Arrow files and back, a task for each record batch."""
    path = fresh(spark, "arrow")
    arrow_files.write_arrow(table(spark, sf_dir, "conversations").repartition(4), path)
    return arrow_files.read_arrow(spark, path).select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("text"))


@query("""WITH r AS (SELECT conv_id::VARCHAR AS task_id, turn, md5(text) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user')
    SELECT task_id, turn, text FROM r WHERE n = 1""")
def arrow_bank(spark, sf_dir):
    """A problem for each conversation: its first user turn, from the first of four sources that has any."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'").withColumn("task_id", F.concat(F.lit(" "), F.col("conv_id").cast("string")))
    empty, other, bank = (fresh(spark, x) for x in ("empty", "other", "bank"))
    turns.limit(0).write.parquet(empty)
    turns.select("turn").write.parquet(other)
    arrow_files.write_arrow(turns.select("task_id", "turn", "text"), bank)
    found = readers.problem_bank(spark, [("arrow", fresh(spark, "none")), ("parquet", empty), ("parquet", other), ("arrow", bank), ("parquet", empty)], "task_id", "turn")
    return found.select("task_id", "turn", F.md5(F.col("text").cast("binary")).alias("text"))


@query()
def split_files(spark, sf_dir):
    """A TSV for each order status in one scan: each row's place in its file, and its half by that file's permutation."""
    path = fresh(spark, "halves")
    note = F.concat("o_orderpriority", F.lit("\nb\t\"c\""))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", note.alias("note"), "o_orderstatus")
    one = orders.repartition("o_orderstatus").sortWithinPartitions("o_orderstatus", "o_orderkey")
    one.withColumn("of", F.col("o_orderstatus")).write.partitionBy("of").options(sep="\t", header=True, quote='"', escape='"', quoteAll=True).csv(path)
    found = readers.tsv_halves(spark, f"{path}/*/*.csv", name=readers.parent_folder(F.col("source_tsv")))
    return found.select("o_orderstatus", "o_orderkey", "pos", "split", "rank")
