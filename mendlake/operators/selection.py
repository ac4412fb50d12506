"""Choosing among candidates: best of a branch, routes between branches, gates, buckets and targets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """How a benchmark ranks candidates and settles ties between the two branches."""

    name: str
    rank: tuple[str, ...]  # descending
    ties_to: str
    keep_buggy_without_verifier: bool
    plain_text_fallback: bool


POLICIES = {
    "assert": Policy("assert", ("acc_pct", "target_ok"), "debug", True, True),
    "io_list": Policy("io_list", ("passed", "acc_pct", "target_ok"), "debug", True, False),
    "stdin": Policy("stdin", ("passed", "problem_passed", "target_ok"), "generation", False, False),
}


def best_candidate(candidates: DataFrame, keys: list[str], policy: Policy, sample: str = "sample") -> DataFrame:
    """The candidate of each key that ranks highest, the earliest sample of equals. The window's limit of one row is
    applied before the shuffle too."""
    order = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in policy.rank], sample)
    return candidates.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def branches(candidates: DataFrame, keys: list[str], measures: list[str], branch: str = "branch") -> DataFrame:
    """One row a key with debug_<measure> and generation_<measure>, null for a branch without candidate."""
    aggs = [F.max(F.when(F.col(branch) == b, F.col(m))).alias(f"{b}_{m}") for b in ("debug", "generation") for m in measures]
    return candidates.groupBy(*keys).agg(*aggs)


def route(policy: Policy) -> Column:
    """'debug' or 'generation' from columns debug_* and generation_*; a missing branch loses."""
    d, g = (lambda m: F.coalesce(F.col(f"debug_{m}").cast("double"), F.lit(-1.0))), (lambda m: F.coalesce(F.col(f"generation_{m}").cast("double"), F.lit(-1.0)))
    if policy.ties_to == "generation":
        out = F.when(g(policy.rank[0]) != d(policy.rank[0]), F.when(g(policy.rank[0]) > d(policy.rank[0]), "generation").otherwise("debug"))
        for m in policy.rank[1:]:
            out = out.when(g(m) != d(m), F.when(g(m) > d(m), "generation").otherwise("debug"))
        return out.otherwise("generation")
    first = policy.rank[0]
    only_gen = (g("target_ok") > 0) & (d("target_ok") <= 0)
    return F.when(g(first) > d(first), "generation").when(d(first) > g(first), "debug").when(only_gen, "generation").otherwise("debug")


def backtrack(selected: Column, baseline: Column) -> Column:
    """True if the selected candidate stays: it passes strictly more tests than the buggy program."""
    return F.coalesce(selected > baseline, F.lit(False))


def verifier_gate(selected: Column, baseline: Column, total: Column, policy: Policy) -> Column:
    """(keep, note) by generated tests: without any, the policy says whether the buggy program stays."""
    empty = F.coalesce(total, F.lit(0)) <= 0
    keep = F.when(empty, F.lit(not policy.keep_buggy_without_verifier)).otherwise(backtrack(selected, baseline))
    note = F.when(total.isNull(), "missing_verifier").when(empty, "empty_verifier").otherwise("")
    return F.struct(keep.alias("keep"), note.alias("note"))


def bucket(acc_pct: Column) -> Column:
    """Q1 (lowest) to Q4 by the baseline's pass rate."""
    return F.when(acc_pct < 25, "Q1").when(acc_pct < 50, "Q2").when(acc_pct < 75, "Q3").otherwise("Q4")


def target_fixed(has_target: Column, target_ok: Column) -> Column:
    return F.when(has_target, F.coalesce(target_ok, F.lit(False)).cast("int")).otherwise(F.lit(0))


def usable_suite(wellformed: Column, n_eval_asserts: Column) -> Column:
    return F.coalesce(wellformed, F.lit(False)) & (F.coalesce(n_eval_asserts, F.lit(0)) > 0)


def random_pick(items: Column, key: Column, seed: int) -> Column:
    """A member of an array chosen by a hash of seed and key, the same in any order of rows; null of none."""
    place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return F.get(items, F.pmod(place, F.greatest(F.size(items), F.lit(1))).cast("int"))


def candidate_summary(passed: Column, total: Column, sample: Column, chosen: Column) -> Column:
    """p1=3/5(60.00%);p2=2/5(40.00%);selected_p1 of one key's candidates (an aggregate)."""
    rows = F.array_sort(F.collect_list(F.struct(sample.cast("long").alias("s"), passed.cast("long").alias("p"), total.cast("long").alias("t"))))
    parts = F.array_join(F.transform(rows, lambda r: F.format_string("p%d=%d/%d(%.2f%%)", r.s, r.p, r.t, 100.0 * r.p / F.greatest(r.t, F.lit(1)))), ";")
    return F.concat(parts, F.lit(";selected_p"), F.min(chosen).cast("string"))
