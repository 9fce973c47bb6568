"""Scaling and interval formulas as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from comeback.functions.scalars import round_half_even

NORMAL_95 = 1.96


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Scale to [0, 1]; a constant column becomes 0."""
    spread = high - low
    return (value - low) / F.when(spread == 0, F.lit(1.0)).otherwise(spread)


def row_mean(values: list[Column]) -> Column:
    return reduce(add, values) / len(values)


def wilson_interval(successes: Column, trials: Column, z: float = NORMAL_95) -> tuple[Column, Column]:
    """Lower and upper bound of the Wilson score interval in percent, one decimal."""
    n = F.when(trials > 0, trials.cast("double"))
    share = successes / n
    z2 = z * z
    scale = 1 + F.lit(z2) / n
    centre = (share + F.lit(z2) / (2 * n)) / scale
    margin = z * F.sqrt(share * (1 - share) / n + F.lit(z2) / (4 * n * n)) / scale

    def bound(value: Column) -> Column:
        return F.coalesce(round_half_even(value * 100, 1), F.lit(0.0))

    return bound(centre - margin), bound(centre + margin)
