"""Distributed running totals, ranks and quantiles against brute force."""

from __future__ import annotations

import hashlib
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from comeback.config import Settings
from comeback.functions.scalars import order_key
from comeback.functions.statistics import wilson_interval
from comeback.operators import evaluation, learning
from comeback.operators.ordered import cut_points, exact_quantile, passed_cuts, running_totals, shuffled_rank
from comeback.operators.sampling import train_test_split


def heavy_tailed(rows: int, seed: int = 3) -> pd.DataFrame:
    """A third of the rows share one value, the rest spread over six orders of magnitude."""
    random = np.random.default_rng(seed)
    values = np.where(random.random(rows) < 1 / 3, 7.0, np.round(10 ** random.uniform(-3, 3, rows), 3))
    return pd.DataFrame({"g": random.choice(["a", "b"], rows), "v": values, "n": random.integers(1, 5, rows)})


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_totals(spark, descending, by):
    data = heavy_tailed(3000).groupby([*by, "v"], as_index=False)["n"].sum()
    got = running_totals(spark.createDataFrame(data), "v", ["n"], by, descending, rows_per_range=100).toPandas()
    want = data.sort_values("v", ascending=not descending)
    want["cum_n"] = want.groupby(by)["n"].cumsum() if by else want["n"].cumsum()
    keys = [*by, "v"]
    pd.testing.assert_frame_equal(
        got.sort_values(keys).reset_index(drop=True),
        want.sort_values(keys).reset_index(drop=True),
        check_dtype=False,
    )


def test_shuffled_rank_is_the_hash_order(spark):
    people = spark.range(5000).select(F.col("id").alias("person_id"), (F.col("id") % 3).alias("g"))
    key = order_key(F.col("person_id"))
    got = shuffled_rank(people, key, "person_id", ["g"]).toPandas()
    got["key"] = [int(hashlib.md5(f"{i}:0".encode()).hexdigest()[:8], 16) for i in got["person_id"]]
    want = got.sort_values(["key", "person_id"]).groupby("g").cumcount() + 1
    assert (got["position"] == want.reindex(got.index)).all()


def test_text_ids_have_an_order(spark):
    people = spark.range(1000).select(F.concat(F.lit("p"), "id").alias("person_id"))
    key = order_key(F.col("person_id"))
    positions = shuffled_rank(people, key, "person_id").toPandas()["position"]
    assert sorted(positions) == list(range(1, 1001))


@pytest.mark.parametrize("share", [0.0, 0.31, 0.5, 0.7, 1.0])
@pytest.mark.parametrize("small", [10, 100_000])
def test_exact_quantile(spark, share, small):
    data = heavy_tailed(4001)
    got = exact_quantile(spark.createDataFrame(data), "v", share, small=small, accuracy=200)
    assert got == pytest.approx(float(np.quantile(data["v"], share)), rel=1e-12)


def test_quantile_of_nothing(spark):
    assert exact_quantile(spark.createDataFrame([(None,)], "v double"), "v", 0.7) is None


def test_area_under_curve_counts_ties_half(spark):
    random = np.random.default_rng(5)
    label = random.integers(0, 2, 800)
    data = pd.DataFrame({"label": label, "probability": np.round(random.random(800) * 0.6 + label * 0.3, 2)})
    got = evaluation.roc_auc(spark.createDataFrame(data)).first()["auc"]
    pos, neg = data[data.label == 1]["probability"].to_numpy(), data[data.label == 0]["probability"].to_numpy()
    wins = (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()
    assert got == pytest.approx(wins, abs=1e-12)
    curve = evaluation.roc_points(spark.createDataFrame(data)).toPandas().sort_values("threshold", ascending=False)
    assert (curve.iloc[0]["fpr"], curve.iloc[0]["tpr"]) == (0, 0)
    assert (curve.iloc[-1]["fpr"], curve.iloc[-1]["tpr"]) == (1, 1)
    assert np.trapezoid(curve["tpr"], curve["fpr"]) == pytest.approx(wins, abs=1e-12)


def test_one_class_has_no_area(spark):
    assert evaluation.roc_auc(spark.createDataFrame([(1, 0.5)], "label int, probability double")).first()["auc"] is None


def test_best_stump_by_hand(spark):
    rows = [(0, 1.0, 5.0), (0, 2.0, 4.0), (1, 3.0, 3.0), (1, 4.0, 3.0), (0, 9.0, 1.0)]
    matrix = spark.createDataFrame(rows, "label int, a double, b double")
    best = learning.best_stump(matrix, ["a", "b"]).first()
    # a >= 3 misses one row, as does b <= 3; the first feature wins.
    assert tuple(best) == ("a", 3.0, 1, 1, 0.2)


def test_wilson(spark):
    low, high = wilson_interval(F.col("s"), F.col("n"))
    rows = spark.createDataFrame([(8, 39), (0, 0), (5, 5)], "s int, n int").select(low, high).collect()
    assert [tuple(r) for r in rows] == [(10.8, 35.5), (0.0, 0.0), (56.6, 100.0)]


def test_order_key_spreads_congruent_ids(spark):
    """Ids that are equal modulo a million and three, and ids as text, land on both sides of a cut."""
    ids = spark.range(3000).selectExpr("id * 1000003 AS person_id")
    low = (order_key(F.col("person_id")) < (1 << 32) // 5).cast("int")
    share = ids.select(F.avg(low)).first()[0]
    assert 0.17 < share < 0.23
    text = ids.select(order_key(F.col("person_id").cast("string")).alias("k")).collect()
    assert text == ids.select(order_key(F.col("person_id")).alias("k")).collect()


@pytest.mark.parametrize("rows", [1, 7, 5000])
def test_cut_points_are_those_of_the_full_order(spark, rows):
    people = spark.range(rows).selectExpr("id AS person_id", "cast(id % 3 as int) AS g")
    cuts = cut_points(people, order_key(F.col("person_id")), "person_id", ["g"], lambda n: [F.lit(0), F.floor(n * 0.3), n * 2])
    got = passed_cuts(people, order_key(F.col("person_id")), "person_id", ["g"], cuts)
    ranked = shuffled_rank(got, order_key(F.col("person_id")), "person_id", ["g"]).toPandas()
    size = ranked.groupby("g")["person_id"].transform("count")
    want = 1 + (ranked["position"] > (size * 0.3).astype(int)).astype(int)
    assert (ranked["_passed"] == want).all()


def test_a_split_moves_no_feature(spark):
    wide = spark.range(1000).selectExpr("id AS person_id", "cast(id % 2 as int) AS label", *[f"rand({i}) AS f{i}" for i in range(5)])
    split = train_test_split(wide, Settings(), "label")
    plan = split._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if "Exchange" in line]
    assert moved and not any("f0#" in line for line in moved)
