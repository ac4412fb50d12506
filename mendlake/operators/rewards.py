"""Rewards of repair and test-generation rollouts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE, PENALTY, PER_ASSERT, ASSERT_CAP = 1000.0, -200.0, 20.0, 10


def repair_reward(usable: Column, passed_before: Column, passed_after: Column, total: Column) -> Column:
    """1000 times the change of the pass rate; 0 for code that can't be used."""
    n = F.greatest(total, F.lit(1))
    return F.when(usable, SCALE * (passed_after / n - passed_before / n)).otherwise(F.lit(0.0))


def improvement(passed_before: Column, passed_after: Column, total: Column) -> Column:
    """frac_improve (of what failed), frac_regress (of what passed) and their signed sum."""
    failed = total - passed_before
    gain = F.when(failed > 0, F.greatest(F.lit(0), passed_after - passed_before) / failed).otherwise(F.lit(0.0))
    loss = F.when(passed_before > 0, F.greatest(F.lit(0), passed_before - passed_after) / passed_before).otherwise(F.lit(0.0))
    return F.struct(gain.alias("frac_improve"), loss.alias("frac_regress"), (gain - loss).alias("signed"))


def test_reward(valid: Column, n_asserts: Column, wellformed: Column, correct: Column, total: Column) -> Column:
    """(reward, reason) of generated tests."""
    rate = correct / F.greatest(total, F.lit(1))
    case = lambda r, why: F.struct(r.cast("double").alias("reward"), F.lit(why).alias("reason"))
    full = SCALE * rate + PER_ASSERT * F.least(correct, F.lit(ASSERT_CAP))
    low = F.lit(PENALTY)
    return F.when(~valid, case(low, "invalid")).when(n_asserts <= 0, case(low, "zero_asserts")).when(~wellformed, case(low, "not_wellformed")).when(n_asserts < ASSERT_CAP, case(F.lit(0.0), "too_few_asserts")).otherwise(case(full, "scored"))


def rate_error(predicted: Column, actual: Column) -> Column:
    """Predicted minus actual pass rate; null where either is unknown."""
    return predicted - actual
