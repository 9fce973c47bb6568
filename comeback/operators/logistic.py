"""Logistic regression by a fixed number of Newton steps on normal equations.

A step is one pass: the weighted products of all pairs of features, and of each with the residuals, are
one Gram matrix of rows (sqrt(w) x, r / sqrt(w)), added up in the tasks; the driver gets p x p numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Least weight of a row; beyond it the prediction is certain.
LEAST = 1e-12
SOLVER = "newton"


@dataclass(frozen=True)
class Logistic:
    """Coefficients of the columns as they are given, and the intercept."""

    columns: tuple[str, ...]
    intercept: float
    weights: tuple[float, ...]

    def raw(self) -> Column:
        terms = [F.col(c).cast("double") * w for c, w in zip(self.columns, self.weights, strict=True)]
        return reduce(lambda a, b: a + b, terms, F.lit(self.intercept))

    def score(self, frame: DataFrame) -> DataFrame:
        """Add ``probability`` and ``prediction``; 0.5 is class 0."""
        scored = frame.withColumn("probability", 1 / (1 + F.exp(-self.raw())))
        return scored.withColumn("prediction", (F.col("probability") > 0.5).cast("int"))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [("", self.intercept), *zip(self.columns, self.weights, strict=True)]
        return spark.createDataFrame(rows, "feature string, coefficient double")


def normal_equations(frame: DataFrame, fitted: Logistic) -> tuple[np.ndarray, np.ndarray]:
    """X'WX and X'r at the fitted coefficients, the intercept's column first."""
    chance = 1 / (1 + F.exp(-fitted.raw()))
    rows = frame.select(*fitted.columns, (F.col("label") == 1).cast("double").alias("_y"), chance.alias("_p"))
    root = F.sqrt(F.greatest(F.col("_p") * (1 - F.col("_p")), F.lit(LEAST)))
    rows = rows.withColumn("_w", root)
    parts = [F.col("_w"), *[F.col(c).cast("double") * F.col("_w") for c in fitted.columns], (F.col("_y") - F.col("_p")) / F.col("_w")]
    vectors = rows.select(array_to_vector(F.array(*parts)).alias("v"))
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v")).computeGramianMatrix().toArray()
    return gram[:-1, :-1], gram[:-1, -1]


def fit_newton(frame: DataFrame, columns: Sequence[str], steps: int, penalty: float = 1.0) -> Logistic:
    """``steps`` Newton steps from zero on (label, columns), labels 0 or 1; ``penalty`` is on half the
    squared weights, not on the intercept. Features should be scaled and hold no nulls."""
    fitted = Logistic(tuple(columns), 0.0, (0.0,) * len(columns))
    ridge = np.diag([0.0] + [penalty] * len(columns))
    for _ in range(steps):
        curvature, gradient = normal_equations(frame, fitted)
        now = np.array([fitted.intercept, *fitted.weights])
        move = np.linalg.lstsq(curvature + ridge, gradient - ridge @ now, rcond=None)[0]
        now = now + move
        fitted = Logistic(tuple(columns), float(now[0]), tuple(map(float, now[1:])))
    return fitted
