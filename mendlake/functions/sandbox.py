"""Running candidate programs in child processes, once for every distinct job.

Spark finds the distinct jobs, deals them out to as many tasks as their number calls for, and joins the outcomes back; a
task runs one child at a time. A child is forked from a warm, isolated interpreter into a session and folder of its own
with limits on CPU time, memory and the bytes it writes; the task kills its whole group on a timeout. Outcomes come by a
channel that candidates don't know of, behind a token. That keeps a worker alive and outcomes apart from what candidates
print; it is no security boundary.

With a store, a folder that all machines share, outcomes outlive a run: they are appended by the job's digest in writes
that double, whose tasks each commit what they ran, and a later run starts the children that are missing only.
"""

from __future__ import annotations

import ast
import contextlib
import json
import os
import secrets
import signal
import socket
import subprocess
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from importlib.resources import as_file, files
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendlake.functions import code
from mendlake.tables import unused, written_once

SUITE_SECONDS, CALLS_SECONDS, PROGRAM_SECONDS, CALL_SECONDS = 10.0, 60.0, 6.0, 2.0
#: Memory of a called function beyond what its interpreter holds; address space of any child; bytes that a child may
#: write to one file, its stdout included: one that writes more is ended by a signal.
CALL_MEMORY, MEMORY, WRITTEN = 256 << 20, 1 << 30, 64 << 20
#: Jobs of a task, at least and at most, tasks of a core before they get more than the least, outcomes of a task that
#: joins them back, and jobs of one commit to a store.
JOBS_A_TASK, MOST_JOBS_A_TASK, TASKS_A_CORE, OUTCOMES_A_TASK, JOBS_A_COMMIT = 32, 128, 8, 256, 10_000
#: A task's file is in the folder when the task has ended, not when all have.
COMMIT_BY_TASK = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


class _Warm:
    """A warm interpreter of this process, which forks a child for every job; it ends when this process does."""

    def __init__(self) -> None:
        self.pid = os.getpid()
        self.socket, theirs = socket.socketpair()
        env = {"PATH": os.environ.get("PATH", ""), "OPENBLAS_NUM_THREADS": "1", "PYTHONIOENCODING": "utf-8"}
        with as_file(files("mendlake.functions").joinpath("child.py")) as path:
            args = [sys.executable, "-I", str(path), str(theirs.fileno())]
            null = subprocess.DEVNULL
            self.process = subprocess.Popen(args, stdin=null, stdout=null, stderr=null, cwd="/", env=env, pass_fds=(theirs.fileno(),), start_new_session=True)
        theirs.close()

    def close(self) -> None:
        self.socket.close()
        self.process.kill()
        self.process.wait()

    def _line(self, seconds: float | None) -> int:
        self.socket.settimeout(seconds)
        got = b""
        while not got.endswith(b"\n"):
            if not (part := self.socket.recv(64)):
                raise ConnectionError("the warm interpreter is gone")
            got += part
            if got.count(b"\n") > 1:  # the status came with the process id
                first, _, self.rest = got.partition(b"\n")
                return int(first)
        return int(got)

    def run(self, given: dict, opened: list[int], seconds: float) -> int | None:
        """The child's return code; None on a timeout."""
        self.rest = b""
        socket.send_fds(self.socket, [json.dumps(given).encode()], opened)
        pid, code = self._line(30.0), None
        try:
            code = int(self.rest) if self.rest.endswith(b"\n") else self._line(seconds)
        except TimeoutError:
            os.killpg(pid, signal.SIGKILL)
            self._line(30.0)
        with contextlib.suppress(ProcessLookupError):  # what it has left behind
            os.killpg(pid, signal.SIGKILL)
        return code


_warm: list[_Warm] = []


def _scratch(name: str, folder: str, on_disk: bool) -> BinaryIO:
    """An open file without a name, of this job alone. Most stay empty or short, and making files on a disk is a good part
    of a child's cost where all cores do it, so they are in memory, if the system has such; a program's output is on disk,
    as it may be long."""
    if on_disk or not hasattr(os, "memfd_create"):
        return tempfile.TemporaryFile(dir=folder)
    return open(os.memfd_create(name), "w+b")


def _run(job: dict, stdin: str, seconds: float) -> tuple[int | None, dict[str, bytes]]:
    """(return code, None on a timeout; what the child wrote to out, err, its outcome's channel and its trace, whole)."""
    if _warm and _warm[0].pid != os.getpid():
        _warm.clear()
    if not _warm:
        _warm.append(_Warm())
    given = {"cpu": int(seconds) + 1, "memory": MEMORY, "written": WRITTEN}
    on_disk = ("out", "err") if job["kind"] == "program" else ()
    with contextlib.ExitStack() as stack:
        folder = stack.enter_context(tempfile.TemporaryDirectory(ignore_cleanup_errors=True))
        named = {n: stack.enter_context(_scratch(n, folder, n in on_disk)) for n in ("in", "out", "err", "job", "outcome", "trace")}
        named["in"].write(stdin.encode(errors="surrogatepass"))
        named["job"].write(json.dumps(job, ensure_ascii=True).encode())
        for n in ("in", "job"):
            named[n].flush()
            named[n].seek(0)
        try:
            code = _warm[0].run(given | {"folder": folder}, [f.fileno() for f in named.values()], seconds)
        except OSError:  # a candidate has ended it, or the machine
            _warm.pop().close()
            code = 1
        wrote = {}
        for n in ("out", "err", "outcome", "trace"):
            named[n].seek(0)
            wrote[n] = named[n].read()
        return code, wrote


def run_child(job: dict, seconds: float) -> dict:
    """Outcome of a job of child.py: results, total, error_type (timeout if the child didn't end in time), error_msg,
    and the lines that were reached, whatever end it took.

    An outcome counts only if it stands alone behind the job's own token.
    """
    token = secrets.token_hex(16)
    job = {"memory": CALL_MEMORY, "call_seconds": CALL_SECONDS, "as_set": False, "cover": False, "helpers": True, "token": token} | job
    code, wrote = _run(job, "", seconds)
    reached = {"lines": sorted({int(x) for x in wrote["trace"].split(b"\n")[:-1] if x.isdigit()})}
    if code == 0 and wrote["outcome"].startswith(token.encode()):
        with contextlib.suppress(ValueError):
            return {"mode": ""} | json.loads(wrote["outcome"][len(token) :]) | reached
    kind, message = ("timeout", f">{seconds}s") if code is None else ("exec", "no result")
    err = wrote["err"].decode(errors="replace")
    return {"results": [], "error_type": kind, "error_msg": message + (f": {err[-2000:]}" if err else ""), "total": None, "mode": kind} | reached


def run_program(source: str, stdin: str, seconds: float = PROGRAM_SECONDS) -> dict:
    """A program on its stdin: ok_process, returncode, stdout, stderr, error_type, error_msg."""
    code, wrote = _run({"kind": "program", "code": source, "token": ""}, stdin, seconds)
    kind = "Timeout" if code is None else "" if code == 0 else "NonZeroExit"
    texts = {f"std{n}": wrote[n].decode(errors="replace") for n in ("out", "err")}
    return {"ok_process": code == 0, "returncode": code, **texts, "error_type": kind, "error_msg": f"timeout >{seconds}s" if code is None else ""}


def n_asserts(tests: str) -> int:
    try:
        return sum(isinstance(n, ast.Assert) for n in ast.walk(ast.parse(tests)))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return 0


def suite_outcome(job: dict, helpers: bool = True) -> dict:
    """The outcome of a suite (code, tests, entry) on a program, in this process's child."""
    got = run_child({"kind": "suite", "code": job["code"], "tests": job["tests"], "entry": job["entry"], "cover": True, "helpers": helpers}, SUITE_SECONDS)
    total = got["total"] if got["total"] is not None else n_asserts(job["tests"] or "")
    return {"results": got["results"], "error_type": got["error_type"], "error_msg": got["error_msg"], "lines": got["lines"], "n_asserts": total}


def _bare_suite(job: dict) -> dict:
    return suite_outcome(job, helpers=False)


def _lists(job: dict) -> dict:
    got = run_child({"kind": "lists", "code": job["_code"]}, CALLS_SECONDS)
    return dict(zip(("inputs", "results"), got.get("lists") or (None, None), strict=True))


def _calls(job: dict) -> dict:
    got = run_child({"kind": "calls", "code": job["code"], "inputs": job["inputs"], "results": job["results"], "entry": job["entry"], "as_set": bool(job["use_set"])}, CALLS_SECONDS)
    results = got["results"]
    if got["total"] is None:  # the child hung or broke: every call counts as timed out
        try:
            n = len(ast.literal_eval(job["inputs"] or "[]"))
        except (ValueError, SyntaxError, TypeError):
            n = 0
        results = [{"index": i, "ok": False, "stdout": "", "error_type": "timeout", "error_msg": got["error_msg"]} for i in range(n)]
    return {"outcome": results, "error_type": got["error_type"]}


def _dataset(job: dict) -> dict:
    got = run_child({"kind": "dataset", "code": job["code"], "tests": job["tests"], "entry": job["entry"]}, SUITE_SECONDS)
    total = got["total"] if got["total"] is not None else 1
    return {"results": got["results"], "total": total, "mode": got["mode"], "error_type": got["error_type"], "error_msg": got["error_msg"]}


def _program(job: dict) -> dict:
    return run_program(job["code"] or "", job["input"] or "")


RESULTS = "array<struct<index:int,ok:boolean,stdout:string,error_type:string,error_msg:string>>"
RESULT_TYPE = pa.list_(pa.struct([("index", pa.int32()), ("ok", pa.bool_()), ("stdout", pa.string()), ("error_type", pa.string()), ("error_msg", pa.string())]))
ARROW = {RESULTS: RESULT_TYPE, "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}


def _there(spark, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _once(df: DataFrame, columns: list[str], run: Callable[[dict], dict], outcome: dict[str, str], store: str | None = None, commit: int | None = None) -> DataFrame:
    """df with the outcome of its distinct values of columns. Rows with equal values, nulls included, share a job.

    store: a folder of outcomes that outlives this call. Jobs that it holds aren't run; the others are appended in
    commits of at most about `commit` jobs, each of which is there whole or not at all: a task commits its own jobs. The
    first write has `commit` jobs and later ones as many as all before, so that their number grows with the logarithm of
    the jobs', and a folder that can't commit by task keeps about a half. df then has `run`, the name of the call that
    ran the row's job.
    """
    spark, commit = df.sparkSession, commit or JOBS_A_COMMIT
    key = unused(df, "job")
    keyed = df.withColumn(key, F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))
    jobs = keyed.groupBy(F.col(key).alias("job")).agg(*[F.first(c).alias(c) for c in columns])
    schema = ", ".join(f"{c} {t}" for c, t in {"job": "string", **outcome}.items())
    name = uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                got = run(row) | {"job": row["job"]}
                yield pa.RecordBatch.from_arrays([pa.array([got["job"]], pa.string()), *[pa.array([got[c]], ARROW[t]) for c, t in outcome.items()]], ["job", *outcome])

    def ran(some: DataFrame, n: int, most: int = MOST_JOBS_A_TASK) -> DataFrame:
        jobs_a_task = min(most, MOST_JOBS_A_TASK, max(JOBS_A_TASK, n // (TASKS_A_CORE * spark.sparkContext.defaultParallelism)))
        return some.repartition(max(1, -(-n // jobs_a_task)), "job").mapInArrow(work, schema)

    if store is None:
        jobs = written_once(jobs, "sandbox-jobs")
        n = jobs.count()
        done = written_once(ran(jobs, n), "sandbox")
    else:
        if _there(spark, store):
            jobs = jobs.join(spark.read.parquet(store).select("job"), "job", "left_anti")
        jobs = written_once(jobs, "sandbox-jobs")
        n = jobs.count()
        parts, begun, part = -(-n // commit), 0, F.pmod(F.xxhash64("job"), F.lit(-(-n // commit)))
        while begun < parts:
            end = min(parts, max(1, 2 * begun))
            some = ran(jobs.filter((part >= begun) & (part < end)), -(-n * (end - begun) // parts), commit)
            some.withColumn("run", F.lit(name)).write.mode("append").options(**COMMIT_BY_TASK).parquet(store)
            begun = end
        kept = ", ".join([schema, "run string"])
        # Two calls at once may both have run a job.
        done = spark.read.schema(kept).parquet(store).dropDuplicates(["job"]) if _there(spark, store) else spark.createDataFrame([], kept)
    # Outputs are long and pack to little in files: never broadcast them, and deal them by their number, not by bytes.
    parts = max(-(-n // OUTCOMES_A_TASK), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return keyed.repartition(parts, key).join(done.withColumnRenamed("job", key).repartition(parts, key).hint("merge"), key).drop(key)


SUITE_OUT = {"results": RESULTS, "error_type": "string", "error_msg": "string", "lines": "array<int>", "n_asserts": "int"}


def run_suites(df: DataFrame, helpers: bool = True, store: str | None = None, commit: int | None = None) -> DataFrame:
    """df (code, tests, entry) with results (by assert of check, as far as it was reached), error_type, error_msg, the
    executed lines of code (also of one that ran out of time), and n_asserts, how many asserts the suite has.

    helpers: whether check's other statements run, too; without them, an assert that needs one fails, and a statement
    that raises can't keep asserts behind it from being run. store, commit: see _once().
    """
    return _once(df, ["code", "tests", "entry"], suite_outcome if helpers else _bare_suite, SUITE_OUT, store, commit)


def run_calls(df: DataFrame, store: str | None = None, commit: int | None = None) -> DataFrame:
    """df (code, entry, inputs, results, use_set; the lists as literal text) with the outcome of every call."""
    return _once(df, ["code", "entry", "inputs", "results", "use_set"], _calls, {"outcome": RESULTS, "error_type": "string"}, store, commit)


def run_dataset_tests(df: DataFrame) -> DataFrame:
    """df (code, tests, entry) with the results of a data set's own tests, total, mode (pairs or whole_check, or what
    went wrong), error_type and error_msg."""
    return _once(df, ["code", "tests", "entry"], _dataset, {"results": RESULTS, "total": "int", "mode": "string", "error_type": "string", "error_msg": "string"})


def run_programs(df: DataFrame, store: str | None = None, commit: int | None = None) -> DataFrame:
    """df (code, input: a row for every program and test) with ok_process, returncode, stdout, stderr, error_type and
    error_msg."""
    return _once(df, ["code", "input"], _program, {"ok_process": "boolean", "returncode": "int", "stdout": "string", "stderr": "string", "error_type": "string", "error_msg": "string"}, store, commit)


def run_lists(df: DataFrame) -> DataFrame:
    """df (tests) with the lists `inputs` and `results` that a check assigns, as literal text, and use_set.

    Only check's own assignments to the two names count, in order. Where both are literals, the text is read; where
    they are expressions, a child evaluates those assignments, with numpy as np. Null without two lists of one length.
    """
    known = df.withColumn("_lists", code.assigned_lists("tests"))
    flat = known.select("*", F.col("_lists.inputs").alias("inputs"), F.col("_lists.results").alias("results"), F.col("_lists.use_set").alias("use_set"), F.col("_lists.assignments").alias("_code")).drop("_lists")
    ran = _once(flat.filter("_code is not null").drop("inputs", "results"), ["_code"], _lists, {"inputs": "string", "results": "string"})
    return flat.filter("_code is null").unionByName(ran).drop("_code")


def single_result(results: Column, total: Column, index: Column, error: Column) -> Column:
    """The result of one assert of run_suites(): (ok, stdout, error_type, error_msg)."""
    one = lambda kind, message: F.struct(F.lit(False).alias("ok"), F.lit("").alias("stdout"), F.lit(kind).alias("error_type"), message.alias("error_msg"))
    at = F.get(results, index)
    found = F.struct(at["ok"].alias("ok"), at["stdout"].alias("stdout"), at["error_type"].alias("error_type"), at["error_msg"].alias("error_msg"))
    outside = F.format_string("assert_index %d out of range [0,%d]", index, total - 1)
    no_result = F.coalesce(F.nullif(error, F.lit("")), F.lit("no thunks"))
    return F.when(F.size(results) == 0, one("exec", no_result)).when((index < 0) | (index >= total), one("index", outside)).when(at.isNull(), one("exec", no_result)).otherwise(found)
