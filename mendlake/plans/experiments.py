"""Experiments as declarative records, and the plan from candidates to metrics that they share."""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mendlake.operators import metrics
from mendlake.operators.selection import POLICIES, Policy, backtrack, bucket, route
from mendlake.tables import written_once


@dataclass(frozen=True)
class Experiment:
    name: str
    kind: str  # debug, generation, routed
    verifier: str  # none, generated, gold
    label: str


EXPERIMENTS = tuple(
    Experiment(f"{kind}_{verifier}", kind, verifier, f"{label} / {tests}")
    for kind, label in (("debug", "Repair"), ("generation", "Rewrite"), ("routed", "Routed"))
    for verifier, tests in (("none", "no tests"), ("generated", "generated tests"), ("gold", "gold tests"))
)


def dimension(spark: SparkSession, experiments: tuple[Experiment, ...] = EXPERIMENTS) -> DataFrame:
    return spark.createDataFrame([astuple(e) for e in experiments], "experiment string, kind string, verifier string, label string")


def selected(candidates: DataFrame, keys: list[str], policy: Policy, extra: tuple[Column, ...] = ()) -> DataFrame:
    """A row for each key with the winner of the routed branches: source, passed, total, problem_passed, target_ok, and
    the aggregates `extra` of all of the key's candidates.

    Candidates that ordering.by_key() has dealt out by key need no other shuffle for ranking, pivot and extra aggregates.
    """
    measures = ["passed", "total", "acc_pct", "problem_passed", "target_ok", "sample"]
    order = W.partitionBy(*keys, "branch").orderBy(*[F.desc(c) for c in policy.rank], "sample")
    ranked = candidates.withColumn("_n", F.row_number().over(order))
    best = lambda b, m: F.max(F.when((F.col("branch") == b) & (F.col("_n") == 1), F.col(m))).alias(f"{b}_{m}")
    both = ranked.groupBy(*keys).agg(*[best(b, m) for b in ("debug", "generation") for m in measures], *extra)
    names = [c for c in both.columns if c not in keys and not c.startswith(("debug_", "generation_"))]
    both = both.withColumn("winner", route(policy))
    pick = lambda m: F.when(F.col("winner") == "debug", F.col(f"debug_{m}")).otherwise(F.col(f"generation_{m}")).alias(m)
    source = F.concat("winner", F.lit("_sample_"), F.when(F.col("winner") == "debug", F.col("debug_sample")).otherwise(F.col("generation_sample")).cast("string"))
    return both.select(*keys, source.alias("source"), *[pick(m) for m in measures if m != "sample"], *names)


def gated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Three modes a key: the winner, the winner if it beats the buggy program on the official tests, and on generated
    tests. df: selected() with gen_passed and the buggy program's measures as base_*."""
    measures = ["passed", "total", "problem_passed", "target_ok"]
    keep = {"non_backtracking": F.lit(True), "oracle_backtracking": backtrack(F.col("passed"), F.col("base_passed")), "verifier_backtracking": backtrack(F.col("gen_passed"), F.col("base_gen_passed"))}
    modes = {m: [*[F.when(k, F.col(c)).otherwise(F.col(f"base_{c}")) for c in measures], F.when(k, F.col("source")).otherwise("buggy")] for m, k in keep.items()}
    return metrics.unpivot_modes(df.withColumn("bucket", bucket(F.col("base_acc_pct"))), [*keys, "bucket"], modes, [*measures, "selected_source"])


def report(by_mode: DataFrame, dims: list[str]) -> DataFrame:
    return by_mode.groupBy(*dims).agg(*metrics.totals(F.col("selected_source")))


def main_table(benchmarks: dict[str, DataFrame], labels: DataFrame) -> DataFrame:
    """The report over several benchmarks: a row for each experiment of labels (experiment, label), in the columns of
    each benchmark (a row an experiment) with its name in front. Raises if a benchmark lacks an experiment."""
    out = labels
    for name, df in benchmarks.items():
        df = written_once(df, "report")  # of about ten rows, checked and joined
        lost = [r[0] for r in labels.join(df, "experiment", "left_anti").orderBy("experiment").select("experiment").collect()]  # of about ten
        if lost:
            raise ValueError(f"{name} has no results of {', '.join(lost)}")
        out = out.join(F.broadcast(df.select("experiment", *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != "experiment"])), "experiment")
    return out


__all__ = ["EXPERIMENTS", "POLICIES", "Experiment", "dimension", "gated", "main_table", "report", "selected"]
