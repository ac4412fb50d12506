"""Options of a run, the registry of evaluators, and counts of what passed through a plan."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from mendlake.functions import sandbox
from mendlake.operators import ordering


@dataclass(frozen=True)
class Options:
    """What to run, on which rows, and how the rows are cut."""

    experiments: tuple[str, ...] = ()
    policy: str = "assert"
    seed: int = 1012
    limit: int = 0
    start: int = 0
    end: int = 0
    n_shards: int = 1
    shard: int = 0
    force: bool = False

    def __post_init__(self):
        if not 0 <= self.shard < self.n_shards:
            raise ValueError(f"shard {self.shard} of {self.n_shards}")

    def record(self, spark: SparkSession) -> DataFrame:
        """The options as one row, to be kept beside a run's results."""
        return spark.createDataFrame([Row(**(asdict(self) | {"experiments": list(self.experiments)}))], "experiments array<string>, policy string, seed long, limit long, start long, end long, n_shards long, shard long, force boolean")

    def rows(self, df: DataFrame, *order: str) -> DataFrame:
        """The slice, limit and shard of df in a total order."""
        placed = ordering.positions(df, *order)
        if self.start or self.end:
            placed = ordering.sliced(placed, self.start, self.end, df.count())
        if self.limit:
            placed = placed.orderBy("pos").limit(self.limit)
        return ordering.shard(placed, self.n_shards, self.shard)


#: Evaluators by name: functions of (jobs) that add outcomes, and the columns that jobs need.
EVALUATORS: dict[str, tuple[Callable[[DataFrame], DataFrame], tuple[str, ...]]] = {
    "assert": (sandbox.run_suites, ("code", "tests", "entry")),
    "dataset": (sandbox.run_dataset_tests, ("code", "tests", "entry")),
    "io_list": (sandbox.run_calls, ("code", "entry", "inputs", "results", "use_set")),
    "stdin": (sandbox.run_programs, ("code", "input")),
}


def evaluate(name: str, jobs: DataFrame) -> DataFrame:
    run, needed = EVALUATORS[name]
    if missing := [c for c in needed if c not in jobs.columns]:
        raise ValueError(f"{name} needs {', '.join(missing)}")
    return run(jobs)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """A result that is there already, unless force; else what make() gives, written there."""
    try:
        if not force:
            return spark.read.parquet(path)
    except AnalysisException:
        pass
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def expanded(path: str) -> str:
    """A path with the user's folder and environment variables filled in."""
    return os.path.expanduser(os.path.expandvars(path))


def observed(df: DataFrame, name: str, **aggs: Column) -> tuple[DataFrame, Observation]:
    """df, and metrics of its rows that are known once an action over it has ended."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in aggs.items()]), seen
