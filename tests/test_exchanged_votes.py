"""Votes with one feature exchanged: against the forest walked for every row and feature by SQL functions."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from comeback.operators import learning, trees

COLUMNS = [f"x{i}" for i in range(6)]


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.range(600, numPartitions=3).select(
        F.col("id").alias("person_id"), *[F.round(F.randn(i) * 2).alias(c) for i, c in enumerate(COLUMNS)]
    )
    noisy = F.col("x0") + F.col("x1") * F.col("x2") + F.randn(9) > 0
    train = rows.withColumn("label", noisy.cast("int")).localCheckpoint()
    return learning.fit_classifier(train, COLUMNS, learning.forest(12, 6, 3)).stages[-1]


def pairs(spark, rows):
    """Rows with values to take, some the same; a fifth without a label."""
    values = [F.array(*[F.round(F.randn(10 * s + i) * 2) for i in range(len(COLUMNS))]) for s in (1, 2)]
    label = F.when(F.col("id") % 5 > 0, (F.col("id") % 2).cast("int")).alias("label")
    return spark.range(rows, numPartitions=2).select("id", label, values[0].alias("values"), values[1].alias("donor")).localCheckpoint()


@pytest.mark.parametrize("rows", [0, 1, trees.WALKED_ROWS + 77])
def test_counts_equal_those_of_all_walks(spark, model, rows):
    given = pairs(spark, rows)
    nodes, depth = trees.model_nodes(spark, model), model.getOrDefault("maxDepth")
    taken = lambda f: F.transform("values", lambda v, i: F.when(i == f, F.get("donor", f)).otherwise(v))
    each = given.select("label", "values", "donor", F.explode(F.sequence(F.lit(-1), F.lit(len(COLUMNS) - 1))).alias("feature"))
    each = each.select("feature", "label", taken(F.col("feature")).alias("v"))
    want = trees.tree_votes(each, F.col("v"), nodes, depth).groupBy("feature", "probability", "label").agg(F.count(F.lit(1)).alias("rows"))
    got = trees.exchanged_counts(given, len(COLUMNS), trees.fetched_nodes(spark, model), depth)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_one_leaf_gives_every_row_its_vote(spark, model):
    nodes = spark.createDataFrame([(0, 0, -1, 0.0, -1, -1, 1.0, 5.0)], trees.SCHEMA).toArrow()
    got = trees.exchanged_counts(pairs(spark, 10), len(COLUMNS), nodes, 6).groupBy("feature", "probability").agg(F.sum("rows"))
    assert sorted(map(tuple, got.collect())) == [(f, 1.0, 10) for f in range(-1, len(COLUMNS))]


def test_walks_take_microseconds(spark, model):
    """60,000 rows, 6 features and 12 trees; walked by functions of arrays once for every feature this took 7 s."""
    nodes = trees.fetched_nodes(spark, model)
    given = pairs(spark, 60_000).coalesce(1).localCheckpoint()
    trees.exchanged_counts(given.limit(10), len(COLUMNS), nodes, 6).collect()
    began = time.time()
    trees.exchanged_counts(given, len(COLUMNS), nodes, 6).collect()
    assert time.time() - began < 4
