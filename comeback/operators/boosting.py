"""Boosted stumps for a 0/1 label: each round adds the split that lowers the logistic loss most.

Rows are stored once as the numbers of their value ranges. A round is one scan: the score of a row is a
lookup per feature, its gradient and curvature are summed per (feature, range), and the best split is
chosen from those sums on the driver. Gradients are summed as whole ten-millionths, so rounds don't
depend on how rows are partitioned.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comeback.functions.scalars import doubles
from comeback.operators.stumps import Limits

UNITS = 1e7


@dataclass(frozen=True)
class Split:
    """Adds ``high`` to the score at or above the threshold, ``low`` below it."""

    feature: str
    threshold: float
    low: float
    high: float
    gain: float


@dataclass(frozen=True)
class Boosted:
    """Log-odds of the training rows, and the splits in order."""

    base: float
    splits: tuple[Split, ...]

    def raw(self) -> Column:
        """The score; equal splits are asked once."""
        low: Counter = Counter()
        high: Counter = Counter()
        for s in self.splits:
            low[s.feature, s.threshold] += s.low
            high[s.feature, s.threshold] += s.high
        terms = [F.when(F.col(f).cast("double") >= t, high[f, t]).otherwise(low[f, t]) for f, t in sorted(low)]
        return reduce(lambda a, b: a + b, terms, F.lit(self.base))

    def score(self, frame: DataFrame) -> DataFrame:
        """Add ``probability`` and ``prediction``; 0.5 is class 0."""
        scored = frame.withColumn("probability", 1 / (1 + F.exp(-self.raw())))
        return scored.withColumn("prediction", (F.col("probability") > 0.5).cast("int"))


def best_split(sums: dict[int, dict[int, tuple[int, int]]], limits: Limits, rate: float, penalty: float) -> tuple[int, int, Split] | None:
    """Feature, range and split with the highest gain over (gradient, curvature) sums per range.

    Ties go to the first feature and the lowest limit; None if no feature has two ranges.
    """
    best = None
    for feature in sorted(sums):
        ranges = sorted(sums[feature])
        gradient = sum(g for g, _ in sums[feature].values()) / UNITS
        curvature = sum(h for _, h in sums[feature].values()) / UNITS
        left = [0, 0]
        for before, at in zip(ranges, ranges[1:], strict=False):
            left = [a + b for a, b in zip(left, sums[feature][before], strict=True)]
            g, h = left[0] / UNITS, left[1] / UNITS
            other_g, other_h = gradient - g, curvature - h
            gain = g * g / (h + penalty) + other_g * other_g / (other_h + penalty) - gradient * gradient / (curvature + penalty)
            if best is None or gain > best[0]:
                best = gain, feature, at, -rate * g / (h + penalty), -rate * other_g / (other_h + penalty)
    if best is None:
        return None
    gain, feature, at, low, high = best
    return feature, at, Split(limits.columns[feature], limits.lows[feature][at], low, high, gain)


def fit_boosted(
    matrix: DataFrame, columns: Sequence[str], rounds: int, bins: int, rate: float = 0.1, penalty: float = 1.0
) -> Boosted:
    """``rounds`` splits on (label, columns); the driver gets two sums per range and round.

    Labels are 0 or 1 and features hold no nulls. With one class only, or no rows, there are no splits.
    """
    counts = matrix.agg(F.count(F.lit(1)), F.count_if(F.col("label") == 1)).first()
    if not 0 < counts[1] < counts[0]:
        return Boosted(0.0 if not counts[0] else math.copysign(50.0, counts[1] - 0.5), ())
    share = counts[1] / counts[0]
    base = math.log(share / (1 - share))
    limits = Limits.fit(matrix, columns, bins)
    rows = matrix.select((F.col("label") == 1).cast("int").alias("label"), limits.numbers().alias("at")).persist()
    try:
        added: dict[int, list[float]] = {}
        splits: list[Split] = []
        for _ in range(rounds):
            terms = [F.get(doubles(values), F.get("at", F.lit(feature))) for feature, values in sorted(added.items())]
            raw = reduce(lambda a, b: a + b, terms, F.lit(base))
            chance = 1 / (1 + F.exp(-raw))
            steps = rows.select("at", "label", chance.alias("p")).select(
                F.rint((F.col("p") - F.col("label")) * UNITS).cast("bigint").alias("g"),
                F.rint(F.col("p") * (1 - F.col("p")) * UNITS).cast("bigint").alias("h"),
                F.posexplode("at").alias("feature", "limit"),
            )
            found = steps.groupBy("feature", "limit").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            sums: dict[int, dict[int, tuple[int, int]]] = {}
            for r in found:
                sums.setdefault(r["feature"], {})[r["limit"]] = r["g"], r["h"]
            best = best_split(sums, limits, rate, penalty)
            if best is None:
                break
            feature, at, split = best
            splits.append(split)
            values = added.setdefault(feature, [0.0] * len(limits.lows[feature]))
            added[feature] = [v + (split.high if i >= at else split.low) for i, v in enumerate(values)]
    finally:
        rows.unpersist()
    return Boosted(base, tuple(splits))
