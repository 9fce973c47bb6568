"""Stump ensembles against numpy: weights, limits, bagging, folds, boosting, attribution."""

from __future__ import annotations

import hashlib
import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from comeback.operators import boosting, learning, stumps, trees
from comeback.operators.ordered import running_totals, value_ranges

COLUMNS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data():
    random = np.random.default_rng(8)
    x = np.stack([random.integers(0, 5, 400), random.normal(size=400).round(2), random.integers(0, 2, 400), random.exponential(size=400).round(1)], axis=1)
    y = ((x[:, 0] + x[:, 1] + random.normal(size=400)) > 2).astype(int)
    return x.astype(float), y


@pytest.fixture(scope="module")
def matrix(spark, data):
    x, y = data
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "person_id bigint, label int, a double, b double, c double, d double").repartition(5)


def first_best(x, y, weights):
    """The first rule with the least weighted error, over features, thresholds, polarities."""
    best = (math.inf,)
    for f in range(x.shape[1]):
        for t in np.unique(x[:, f]):
            for polarity in (1, -1):
                error = sum(w for w, p, k in zip(weights, polarity * (x[:, f] - t) >= 0, y, strict=True) if p != k)
                if error < best[0]:
                    best = error, f, t, polarity
    return best


@pytest.mark.parametrize("kind", ["fractions", "zeros", "nulls", "ties"])
def test_weighted_stump(spark, data, matrix, kind):
    x, y = data
    weights = {
        "fractions": [1 / (1 + i % 9) for i in range(400)],
        "zeros": [float(i % 3 == 0) for i in range(400)],
        "nulls": [None if i % 4 else 0.5 for i in range(400)],
        "ties": [0.0] * 400,
    }[kind]
    table = spark.createDataFrame(list(enumerate(weights)), "person_id bigint, weight double")
    row = learning.best_stump(matrix.join(table, "person_id"), COLUMNS, "weight").first()
    exact = [round((w or 0.0) * 10**9) for w in weights]
    error, f, t, polarity = first_best(x, y, exact)
    assert (row["feature"], row["threshold"], row["polarity"]) == (COLUMNS[f], t, polarity)
    assert row["errors"] == pytest.approx(error / 1e9)


def test_equal_weights_are_counts(matrix):
    plain = learning.best_stump(matrix, COLUMNS).first()
    ones = learning.best_stump(matrix.withColumn("weight", F.lit(1.0)), COLUMNS, "weight").first()
    assert tuple(plain) == tuple(ones)


@pytest.mark.parametrize("bins", [3, 16, 256])
def test_limits(data, matrix, bins):
    x, _ = data
    limits = stumps.Limits.fit(matrix, COLUMNS, bins)
    for f in range(4):
        values = np.unique(x[:, f])
        lows, tops = limits.lows[f], limits.tops[f]
        assert len(lows) <= max(bins, 1) and set(lows) | set(tops) <= set(values) and list(lows) == sorted(lows)
        if len(values) <= bins:
            assert list(lows) == list(tops) == values.tolist()
    rows = matrix.select(*COLUMNS, limits.numbers().alias("at")).collect()
    for r in rows:
        assert r["at"] == [int(np.searchsorted(limits.lows[f], r[c], side="right")) - 1 for f, c in enumerate(COLUMNS)]
        assert all(limits.lows[f][i] <= r[c] <= limits.tops[f][i] for f, (c, i) in enumerate(zip(COLUMNS, r["at"], strict=True)))


def times(person, tree, seed):
    key = int(hashlib.md5(f"{person}:0".encode()).hexdigest()[:8], 16)
    digest = hashlib.md5(f"{seed}:{tree}".encode()).hexdigest()
    u = (key * (int(digest[:7], 16) + 1) + int(digest[7:15], 16)) % stumps.PRIME
    return sum(u >= limit for limit in stumps.DRAWS)


def test_forest_is_the_best_rule_of_each_sample(data, matrix):
    x, y = data
    forest = stumps.fit_forest(matrix, COLUMNS, 40, 3, 256)
    draws = stumps.drawn_features(4, 40, 3)
    assert len(forest.rules) == 40 and all(len(d) == 2 for d in draws) and len({tuple(d) for d in draws}) > 3
    for rule, drawn in zip(forest.rules, draws, strict=True):
        weights = [times(i, rule.tree, 3) for i in range(400)]
        held = np.array(weights) > 0
        error, f, t, polarity = first_best(x[held][:, drawn], y[held], [w for w in weights if w])
        assert (rule.feature, rule.threshold, rule.polarity, rule.errors) == (COLUMNS[drawn[f]], t, polarity, error)
        assert rule.drawn == sum(weights)
    assert 0.9 < np.mean([r.drawn for r in forest.rules]) / 400 < 1.1
    assert stumps.fit_forest(matrix.repartition(2), COLUMNS, 40, 3, 256) == forest
    share = {r["person_id"]: r["probability"] for r in forest.score(matrix).collect()}
    for i in range(0, 400, 13):
        votes = [r.polarity * (x[i, COLUMNS.index(r.feature)] - r.threshold) >= 0 for r in forest.rules]
        assert share[i] == pytest.approx(np.mean(votes))


def test_folds_are_forests_of_the_other_rows(matrix):
    folded = matrix.withColumn("fold", (F.col("person_id") % 3).cast("int"))
    forests = stumps.fit_folds(folded, COLUMNS, 3, 20, 5, 256)
    for fold, forest in forests.items():
        alone = stumps.fit_forest(folded.where(f"fold <> {fold}"), COLUMNS, 20, 5, 256)
        assert [(r.feature, r.threshold, r.polarity, r.errors) for r in forest.rules] == [
            (r.feature, r.threshold, r.polarity, r.errors) for r in alone.rules
        ]
    scored = {r["person_id"]: r["probability"] for r in stumps.score_folds(folded, forests).collect()}
    for fold, forest in forests.items():
        own = {r["person_id"]: r["probability"] for r in forest.score(folded.where(f"fold = {fold}")).collect()}
        assert all(scored[i] == p for i, p in own.items())


def test_no_rows_and_one_class(spark, matrix):
    none = matrix.where("person_id < 0")
    assert stumps.fit_forest(none, COLUMNS, 5, 1, 16).rules == ()
    assert {r["probability"] for r in stumps.StumpForest(("a",), ()).score(matrix).collect()} == {0.0}
    ones = matrix.where("label = 1")
    assert {r["probability"] for r in stumps.fit_forest(ones, COLUMNS, 5, 1, 16).score(ones).collect()} == {1.0}
    assert boosting.fit_boosted(ones, COLUMNS, 3, 16).splits == () and boosting.fit_boosted(none, COLUMNS, 3, 16).splits == ()


def test_boosting_follows_the_loss(data, matrix):
    """Each round against numpy; more rounds begin with the same splits and lower the loss."""
    x, y = data
    model = boosting.fit_boosted(matrix, COLUMNS, 12, 256)
    assert boosting.fit_boosted(matrix.repartition(2), COLUMNS, 3, 256).splits == model.splits[:3]
    raw = np.full(400, model.base)
    losses = []
    for split in model.splits:
        p = 1 / (1 + np.exp(-raw))
        losses.append(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
        g, h = np.rint((p - y) * 1e7) / 1e7, np.rint(p * (1 - p) * 1e7) / 1e7
        gains = []
        for f in range(4):
            for t in np.unique(x[:, f])[1:]:
                left = x[:, f] < t
                parts = [(g[s].sum(), h[s].sum() + 1) for s in (left, ~left, slice(None))]
                gains.append(parts[0][0] ** 2 / parts[0][1] + parts[1][0] ** 2 / parts[1][1] - parts[2][0] ** 2 / parts[2][1])
        assert split.gain == pytest.approx(max(gains))
        raw = raw + np.where(x[:, COLUMNS.index(split.feature)] >= split.threshold, split.high, split.low)
    assert losses == sorted(losses, reverse=True)
    scored = {r["person_id"]: r["probability"] for r in model.score(matrix).collect()}
    assert [scored[i] for i in range(400)] == pytest.approx((1 / (1 + np.exp(-raw))).tolist())


def expected(nodes, tree, node, x, known):
    """Value of a tree when only the features in ``known`` are told."""
    n = nodes[tree, node]
    if n["left"] < 0:
        return n["prediction"]
    if n["feature"] in known:
        return expected(nodes, tree, n["left"] if x[n["feature"]] <= n["threshold"] else n["right"], x, known)
    parts = [nodes[tree, c]["cover"] / n["cover"] * expected(nodes, tree, c, x, known) for c in (n["left"], n["right"])]
    return sum(parts)


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_attribution_equals_all_subsets(spark, matrix, depth):
    model = learning.fit_classifier(matrix, COLUMNS, learning.forest(6, depth, 5))
    plain = learning.PipelineModel(model.stages[:-1]).transform(matrix)
    scaled = plain.select("person_id", *[F.col(f"z{i}").alias(c) for i, c in enumerate(COLUMNS)])
    table = trees.model_nodes(spark, model.stages[-1])
    got, base = trees.attribution(scaled, COLUMNS, table)
    nodes = {(n["tree"], n["node"]): n for n in table.collect()}
    added = {}
    for r in got.collect():
        added.setdefault(r["person_id"], {})[r["feature"]] = r["contribution"]
    voted = trees.tree_votes(scaled, F.array(*COLUMNS), table, depth).collect()
    assert len(voted) == 400
    for r in voted:
        assert math.fsum(added[r["person_id"]].values()) + base == pytest.approx(r["probability"])
    assert base == pytest.approx(sum(expected(nodes, t, 0, None, ()) for t in range(6)) / 6)
    for r in voted[::40]:
        x = [r[c] for c in COLUMNS]
        for f, name in enumerate(COLUMNS):
            others = [i for i in range(4) if i != f]
            want = 0.0
            for size in range(4):
                weight = math.factorial(size) * math.factorial(3 - size) / math.factorial(4)
                for known in combinations(others, size):
                    want += weight * sum(expected(nodes, t, 0, x, (*known, f)) - expected(nodes, t, 0, x, known) for t in range(6)) / 6
            assert added[r["person_id"]].get(name, 0.0) == pytest.approx(want, abs=1e-9)


def test_exchanged_votes_equal_exchanged_rows(matrix):
    """Counts per feature against scoring rows whose feature was really exchanged."""
    forest = stumps.fit_forest(matrix, COLUMNS, 20, 3, 256)
    found = {(r["feature"], round(r["probability"], 9), r["label"]): r["rows"] for r in stumps.exchanged_votes(matrix, forest, 7).collect()}
    rows = {r["person_id"]: r for r in matrix.collect()}

    def order(seed):
        return sorted(rows, key=lambda i: (int(hashlib.md5(f"{i}:{seed}".encode()).hexdigest()[:8], 16), i))

    def share(values):
        return sum(r.polarity * (values[r.feature] - r.threshold) >= 0 for r in forest.rules) / 20

    want: dict = {}
    for here, there in zip(order(0), order(7), strict=True):
        own = rows[here].asDict()
        for feature in ("", *COLUMNS):
            values = own | ({feature: rows[there][feature]} if feature else {})
            key = feature, round(share(values), 9), own["label"]
            want[key] = want.get(key, 0) + 1
    assert found == want


def test_ranges_follow_the_data(spark):
    """A hundred times the rows: as many times the ranges, and none grows."""
    for rows in (20_000, 2_000_000):
        skewed = spark.range(rows).select((F.col("id") * F.col("id") / rows).alias("v"), F.lit(1).alias("n"))
        placed, ranges = value_ranges(skewed, "v", rows_per_range=5_000)
        sizes = [r["count"] for r in placed.groupBy("_range").count().collect()]
        assert ranges == rows / 5_000 and sum(sizes) == rows and max(sizes) <= 4 * 5_000
    last = running_totals(skewed, "v", ["n"], rows_per_range=5_000).agg(F.max("cum_n"), F.countDistinct("cum_n")).first()
    assert tuple(last) == (rows, rows)
