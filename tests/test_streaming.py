import json
import random
import time

import pytest
from mendlake.operators import metrics
from mendlake.plans.queries import QUERIES
from mendlake.streaming import log
from pyspark.sql import functions as F
from pyspark.sql import types as T


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "events")
    spark.read.parquet(f"{sf}/events.parquet").repartition(7).write.parquet(path)
    return path


def test_batches_give_the_replayed_state(spark, folder):
    df = spark.read.parquet(folder)
    got = log.streamed_state(spark, folder, df.schema, ["user_id"], ["ts", "event_id"], files_per_batch=2)
    want = log.replay(df, ["user_id"], "ts", "event_id")
    assert sorted(map(tuple, got.select("user_id", "event_id").collect())) == sorted(map(tuple, want.select("user_id", "event_id").collect()))


def test_fold_runs_in_batches(spark, folder):
    schema = spark.read.parquet(folder).schema
    got = log.streamed_state(spark, folder, schema, ["user_id"], ["ts", "event_id"], fold=lambda b: b.filter("event_type = 'click'"))
    assert {r[0] for r in got.select("event_type").distinct().collect()} == {"click"}


def test_running_totals(spark, folder):
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(folder)
    query = log.running_totals(stream, ["event_type"], [F.count(F.lit(1)).alias("n")]).writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    query.awaitTermination()
    want = spark.read.parquet(folder).groupBy("event_type").count()
    assert sorted(map(tuple, spark.table("totals").collect())) == sorted(map(tuple, want.collect()))


def test_relevant(spark):
    rows = [("final_metrics", "x", "a"), ("final_metrics", None, "b"), ("final_metrics", "other", "c"), ("started", "x", "d"), ("final_metrics", "x", " ")]
    df = spark.createDataFrame(rows, "event string, experiment string, task_id string")
    assert [r["task_id"] for r in log.relevant(df, "x", ["final_metrics", "skipped_prepare_row"], "task_id").collect()] == ["a", "b"]


def test_rolled_up_total_is_the_sum(spark, sf):
    rows = QUERIES["rollup_global"](spark, sf).collect()
    whole = next(r for r in rows if r["level"] == 3)
    assert whole["passed"] == sum(r["passed"] for r in rows if r["level"] == 0) == sum(r["passed"] for r in rows if r["level"] == 1)
    assert metrics.totals()


SCHEMA = T.StructType().add("k", T.StringType()).add("n", T.LongType()).add("text", T.StringType())


def write_log(root, name, data, cuts):
    """A log's bytes as segments that are cut at these places."""
    at = [0, *cuts, len(data)]
    for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
        folder = root / f"log={name}" / f"segment={i}"
        folder.mkdir(parents=True)
        (folder / "lines.jsonl").write_bytes(data[a:b])


def made_log(seed, n):
    rng = random.Random(seed)
    lines = []
    for i in range(n):
        line = json.dumps({"k": rng.choice(["a", "b", "ü", None]), "n": i, "text": "é" * rng.randrange(1, 30)}, ensure_ascii=False)
        lines.append(rng.choice([line, line, line, line[: len(line) // 2], "", "[1, 2]" if i % 2 else "  "]))
    data = "\n".join(lines).encode() + b"\n" + '{"k": "a", "n": 9999, "text": "no end'.encode()
    return data, sorted(rng.sample(range(1, len(data)), 25)), lines


def last_of(lines):
    last = {}
    for line in lines:
        try:
            row = json.loads(line)
        except ValueError:
            continue
        if isinstance(row, dict):
            last[row["k"]] = row["n"]
    return last


def test_torn_log_after_a_stop(spark, tmp_path):
    """Torn lines and characters, segments of no line; the stream is stopped between two batches and started anew."""
    root, base = tmp_path / "logs", f"file://{tmp_path}/base"
    data, cuts, lines = made_log(3, 80)
    write_log(root, "one", data, cuts)
    with log.state_provider(spark):
        query = log.log_lines(spark, f"file://{root}", base, files_per_batch=3).start()
        while not query.lastProgress or query.lastProgress["batchId"] < 2:
            time.sleep(0.1)
        query.stop()
    half = spark.read.parquet(f"{base}/lines").count()
    assert 0 < half < len(lines)
    got = log.streamed_log(spark, f"file://{root}", SCHEMA, ["k"], base, files_per_batch=3)
    assert {r["k"]: r["n"] for r in got.collect()} == last_of(lines)
    whole = spark.read.parquet(f"{base}/lines").orderBy("segment", "line").collect()
    assert [r["text"] for r in whole] == lines  # every line once, the one without an end not yet
    folder = root / "log=one" / f"segment={len(cuts) + 1}"
    folder.mkdir()
    (folder / "lines.jsonl").write_bytes(b' till now"}\n')  # the rest of it
    again = log.streamed_log(spark, f"file://{root}", SCHEMA, ["k"], base)
    assert {r["k"]: (r["n"], r["text"]) for r in again.collect()}["a"] == (9999, "no end till now")
    batch = log.replay(spark.read.parquet(f"{base}/lines").select("segment", "line", F.from_json("text", SCHEMA).alias("r")).select("segment", "line", "r.*").filter("n is not null"), ["k"], "segment", "line")
    assert sorted(map(str, batch.select("k", "n").collect())) == sorted(map(str, again.select("k", "n").collect()))


def test_segments_before_their_turn(spark, tmp_path):
    """Segments that come late or again, and logs that don't mix."""
    root, base = tmp_path / "logs", f"file://{tmp_path}/base"
    late = root / "log=x" / "segment=0"
    for i, piece in ((1, b'"n": 1}\n{"k": "b",'), (2, b' "n": 2}\n')):
        (root / "log=x" / f"segment={i}").mkdir(parents=True)
        (root / "log=x" / f"segment={i}" / "lines.jsonl").write_bytes(piece)
    write_log(root, "y", b'{"k": "c", "n": 5}\n', [4, 5])
    first = log.streamed_log(spark, f"file://{root}", SCHEMA, ["k"], base)
    assert {(r["k"], r["n"]) for r in first.collect()} == {("c", 5)}
    late.mkdir()
    (late / "lines.jsonl").write_bytes(b'{"k": "a", ')
    got = log.streamed_log(spark, f"file://{root}", SCHEMA, ["k"], base)
    assert {(r["k"], r["n"]) for r in got.collect()} == {("a", 1), ("b", 2), ("c", 5)}


def test_state_grows_with_keys_not_batches(spark, folder):
    df = spark.read.parquet(folder)
    got = log.streamed_state(spark, folder, df.schema, ["event_type"], ["event_id"], files_per_batch=1)
    assert got.count() == df.select("event_type").distinct().count()
    none = log.streamed_state(spark, folder, df.schema, ["event_type"], ["event_id"], fold=lambda b: b.filter("event_id < 0"))
    assert none.count() == 0


def test_batches_by_bytes(spark, tmp_path):
    """Many short segments are a batch together."""
    root, base = tmp_path / "logs", f"file://{tmp_path}/base"
    data = "".join(f'{{"k": "{i % 3}", "n": {i}}}\n' for i in range(240)).encode()
    write_log(root, "one", data, list(range(20, len(data), 20)))
    got = log.streamed_log(spark, f"file://{root}", SCHEMA, ["k"], base)
    assert {r["k"]: r["n"] for r in got.collect()} == {"0": 237, "1": 238, "2": 239}
    commits = [f for part in ("tails", "state") for f in (tmp_path / "base" / part / "commits").iterdir() if f.name.isdigit()]
    assert len(list(root.rglob("*.jsonl"))) > 150 and len(commits) == 2
