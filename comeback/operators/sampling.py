"""Reproducible samples, splits and folds ordered by a hash of the person id."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comeback.config import Settings
from comeback.functions.scalars import order_key
from comeback.operators.ordered import cut_points, passed_cuts

ID = "person_id"


def _key() -> Column:
    return order_key(F.col(ID))


def simple_sample(frame: DataFrame, limit: int = 3000) -> DataFrame:
    """At most ``limit`` rows; each task keeps only its own first ``limit``."""
    ordered = frame.withColumn("_key", _key()).orderBy("_key", ID)
    return ordered.limit(limit).drop("_key")


def _cut(frame: DataFrame, strata: list[str], positions: Callable[[Column], Sequence[Column]]) -> DataFrame:
    """Add ``_passed``, from cut points in hash order; rows are not moved."""
    points = cut_points(frame, _key(), ID, strata, positions)
    return passed_cuts(frame, _key(), ID, strata, points)


def stratified_sample(frame: DataFrame, label: str, limit: int = 800) -> DataFrame:
    """At most ``limit`` rows of each label."""
    return _cut(frame, [label], lambda size: [F.lit(limit)]).filter("_passed = 0").drop("_passed")


def train_test_split(frame: DataFrame, settings: Settings, label: str | None = None) -> DataFrame:
    """Add ``split``: the first share of each class (or of all rows) in hash order is the test set.

    A class never has an empty test set.
    """

    def wanted(size: Column) -> list[Column]:
        share = F.floor(size * settings.test_share)
        return [share if label is None else F.greatest(F.lit(1), share)]

    cut = _cut(frame, [] if label is None else [label], wanted)
    return cut.withColumn("split", F.when(F.col("_passed") == 0, "test").otherwise("train")).drop("_passed")


def cross_validation_folds(frame: DataFrame, label: str, folds: int) -> DataFrame:
    """Add ``fold`` 0 .. folds-1: equal stretches of the hash order of each class."""
    ends = _cut(frame, [label], lambda size: [F.ceil(size * n / folds) for n in range(1, folds)])
    return ends.withColumnRenamed("_passed", "fold")
