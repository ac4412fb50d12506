"""Rewards of batches of rollouts: functions from columns as lists to a list of numbers, as trainers call them.

A reward function is registered with the columns that it needs. Spark hands it one batch at a time as Arrow columns, in
the task that holds the batch, so a function may look at the whole batch and run its programs in the sandbox.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendlake.functions import sandbox
from mendlake.functions.code import asserts_of, parsed, unfenced
from mendlake.operators.ordering import dealt
from mendlake.operators.rewards import ASSERT_CAP, PENALTY, PER_ASSERT, SCALE


@dataclass(frozen=True)
class Reward:
    run: Callable[[dict[str, list]], list[float | None]]
    needed: tuple[str, ...]


REWARDS: dict[str, Reward] = {}


def reward(name: str, *needed: str):
    """Register a function of {column: list} under a name, with the columns that it needs."""

    def put(f: Callable[[dict[str, list]], list[float | None]]):
        REWARDS[name] = Reward(f, needed)
        return f

    return put


def text_of(completion: object) -> str:
    """A completion as text: a text, or the content of the first of a list of messages."""
    if isinstance(completion, list):
        completion = completion[0] if completion else ""
    if isinstance(completion, dict):
        completion = completion.get("content")
    return completion if isinstance(completion, str) else ""


def _code(completion: object) -> str:
    x = text_of(completion)
    return unfenced(re.sub(r"<think>.*?</think>", "", x, flags=re.S))


def _n_passed(code: str, tests: str | None, entry: str | None) -> tuple[int, int]:
    got = sandbox.suite_outcome({"code": code, "tests": tests, "entry": entry})
    return sum(r["ok"] for r in got["results"]), got["n_asserts"]


@reward("repair", "completion", "tests", "entry", "passed_before", "total")
def repair(columns: dict[str, list]) -> list[float | None]:
    """1000 times the change of the pass rate; 0 for a completion without code that parses. Equal rows run once."""
    known: dict[tuple, int] = {}
    out: list[float | None] = []
    for completion, tests, entry, before, total in zip(*(columns[c] for c in REWARDS["repair"].needed), strict=True):
        code = _code(completion)
        if not code.strip() or parsed(code) is None:
            out.append(0.0)
            continue
        key = (code, tests, entry)
        if key not in known:
            known[key] = _n_passed(*key)[0]
        n = max(total or 0, 1)
        out.append(SCALE * (known[key] / n - (before or 0) / n))
    return out


@reward("tests", "completion", "gold", "entry")
def generated_tests(columns: dict[str, list]) -> list[float | None]:
    """Penalties for suites that don't parse or have no asserts, 0 for too few, else by the asserts that hold on the
    gold program."""
    out: list[float | None] = []
    for completion, gold, entry in zip(*(columns[c] for c in REWARDS["tests"].needed), strict=True):
        suite = _code(completion)
        n = len(asserts_of(suite))
        if parsed(suite) is None or "def check" not in suite or not n:
            out.append(PENALTY)
        elif n < ASSERT_CAP:
            out.append(0.0)
        else:
            correct, total = _n_passed(gold or "", suite, entry)
            out.append(SCALE * correct / max(total, 1) + PER_ASSERT * min(correct, ASSERT_CAP))
    return out


def rewarded(df: DataFrame, name: str, batch: str, out: str = "reward") -> DataFrame:
    """df with the reward of each row. batch: the column of the batch that a row belongs to; a batch is held by one
    task, as a trainer's is by one step. Raises on columns that the function needs and df lacks; a function that gives
    another number of rewards than rows, or one that isn't finite, fails the task."""
    fn = REWARDS[name]
    if missing := [c for c in fn.needed if c not in df.columns]:
        raise ValueError(f"{name} needs {', '.join(missing)}")
    if out in df.columns:
        raise ValueError(f"there is a column {out}")
    schema = T.StructType([*df.schema, T.StructField(out, T.DoubleType())])

    def scored(rows: pa.Table) -> pa.Table:
        got = fn.run({c: rows.column(c).to_pylist() for c in fn.needed})
        if len(got) != rows.num_rows or not all(x is None or math.isfinite(x) for x in got):
            raise ValueError(f"{name}: {len(got)} rewards of {rows.num_rows} rows, or one that isn't finite")
        return rows.append_column(out, pa.array(got, pa.float64()))

    return dealt(df, batch).groupBy(batch).applyInArrow(scored, schema)  # few bytes, but a child for each row


def batch_of(df: DataFrame, size: int, pos: str = "pos", name: str = "batch") -> DataFrame:
    """df with the number of the batch of `size` rows that a row's place belongs to."""
    return df.withColumn(name, F.floor(F.col(pos) / size).cast("long"))
