"""Ensembles of one-split rules, fitted on counted value ranges.

Each feature has at most ``bins`` candidate limits; a row is stored once as the numbers of its limits.
All trees of a bagged forest, and all leave-one-out folds of it, are then answered by a single
aggregate over (tree, feature, limit): bootstrap counts and feature draws are expressions of a hash
of the row's id and the tree, and a fold's training counts are the totals less its own. Sums are whole
numbers, so results don't depend on how rows are partitioned.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from comeback.functions.scalars import doubles, order_key, passed_limits
from comeback.operators import trees
from comeback.operators.ordered import running_totals, shuffled_rank

ID = "person_id"
#: A prime above the number of order keys.
PRIME = 4_294_967_311
#: u below the n-th of these numbers (of PRIME) draws a row less than n + 1 times: Poisson with mean 1.
DRAWS = tuple(int(PRIME * sum(math.exp(-1) / math.factorial(k) for k in range(n + 1))) for n in range(8))


@dataclass(frozen=True)
class Limits:
    """Candidate limits of each feature, ascending: the least and the largest value of every range."""

    columns: tuple[str, ...]
    lows: tuple[tuple[float, ...], ...]
    tops: tuple[tuple[float, ...], ...]

    @classmethod
    def fit(cls, matrix: DataFrame, columns: Sequence[str], bins: int) -> Limits:
        """Every distinct value of a feature that has at most ``bins``; else ranges of equal row counts."""
        entries = [F.struct(F.lit(i).alias("feature"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)]
        counts = matrix.select(F.inline(F.array(*entries))).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("rows"))
        sizes = counts.groupBy("feature").agg(F.count(F.lit(1)).alias("values"), F.sum("rows").alias("total"))
        ranked = running_totals(counts.withColumn("one", F.lit(1)), "value", ["rows", "one"], ["feature"])
        slot = F.when(F.col("values") <= bins, F.col("cum_one")).otherwise(F.expr(f"(cum_rows - 1) * {bins} div total"))
        slots = ranked.join(F.broadcast(sizes), "feature").groupBy("feature", slot.alias("slot"))
        found = slots.agg(F.min("value").alias("low"), F.max("value").alias("top")).orderBy("feature", "low").collect()
        lows: list[list[float]] = [[] for _ in columns]
        tops: list[list[float]] = [[] for _ in columns]
        for row in found:
            lows[row["feature"]].append(row["low"])
            tops[row["feature"]].append(row["top"])
        return cls(tuple(columns), tuple(map(tuple, lows)), tuple(map(tuple, tops)))

    def numbers(self) -> Column:
        """An array with the number of each feature's last limit at or below the value."""
        return F.array(
            *[
                passed_limits(doubles(lows), F.col(c).cast("double"), len(lows)) - 1
                for c, lows in zip(self.columns, self.lows, strict=True)
            ]
        )


def hashed(*parts: object) -> str:
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def drawn_features(features: int, many: int, seed: int) -> list[list[int]]:
    """The sqrt(features) features of each tree: those with the least hashes, in their own order."""
    tried = max(1, math.isqrt(features))
    return [sorted(sorted(range(features), key=lambda f: (hashed(seed, t, f), f))[:tried]) for t in range(many)]


def tree_factors(tree: int, seed: int) -> tuple[int, int]:
    """Factor and summand of a tree's hash of order keys."""
    digest = hashed(seed, tree)
    return int(digest[:7], 16) + 1, int(digest[7:15], 16)


def times_drawn(key: Column, factor: Column, summand: Column) -> Column:
    """How often a row with this order key is in a tree's bootstrap sample."""
    draw = (key * factor + summand) % F.lit(PRIME)
    return sum(((draw >= limit).cast("int") for limit in DRAWS), F.lit(0))


@dataclass(frozen=True)
class Rule:
    """Predicts 1 at or above the threshold (polarity 1), or at or below it (-1).

    ``gain`` is the decrease of Gini impurity per drawn row; ``drawn_left`` of the ``drawn`` rows lie below
    the threshold, or at it with polarity -1.
    """

    tree: int
    feature: str
    threshold: float
    polarity: int
    errors: int
    gain: float
    drawn: int
    drawn_left: int

    def holds(self) -> Column:
        value = F.col(self.feature).cast("double")
        return value >= self.threshold if self.polarity == 1 else value <= self.threshold


@dataclass(frozen=True)
class StumpForest:
    """Fitted rules, one per tree (none for a tree whose sample is empty)."""

    columns: tuple[str, ...]
    rules: tuple[Rule, ...]

    def share(self) -> Column:
        """Share of rules that predict 1; equal rules are asked once."""
        same = Counter((r.feature, r.threshold, r.polarity) for r in self.rules)
        known = {(r.feature, r.threshold, r.polarity): r for r in self.rules}
        votes = [F.when(known[k].holds(), n).otherwise(0) for k, n in sorted(same.items())]
        return reduce(lambda a, b: a + b, votes, F.lit(0)) / F.lit(max(1, len(self.rules)))

    def score(self, frame: DataFrame) -> DataFrame:
        """Add ``probability`` and ``prediction``; a tie is class 0."""
        scored = frame.withColumn("probability", self.share())
        return scored.withColumn("prediction", (F.col("probability") > 0.5).cast("int"))

    def importance(self, spark: SparkSession, limit: int = 15) -> DataFrame:
        """The features whose splits lower impurity most, as parts of the whole."""
        gains = dict.fromkeys(self.columns, 0.0)
        for rule in self.rules:
            gains[rule.feature] += rule.gain
        whole = math.fsum(gains.values()) or 1.0
        rows = [(c, g / whole) for c, g in gains.items()]
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(limit)

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The rules as a node table, see ``trees``."""
        rows = []
        for number, rule in enumerate(self.rules):
            # At or above t is above the number before t.
            limit = rule.threshold if rule.polarity == -1 else math.nextafter(rule.threshold, -math.inf)
            low = 1.0 if rule.polarity == -1 else 0.0
            rows += [
                (number, 0, self.columns.index(rule.feature), limit, 1, 2, 0.0, float(rule.drawn)),
                (number, 1, -1, 0.0, -1, -1, low, float(rule.drawn_left)),
                (number, 2, -1, 0.0, -1, -1, 1.0 - low, float(rule.drawn - rule.drawn_left)),
            ]
        return spark.createDataFrame(rows, trees.SCHEMA)


def _cells(matrix: DataFrame, limits: Limits, many: int, seed: int, by: Sequence[str]) -> DataFrame:
    """Drawn positives and negatives of every (by, tree, feature, limit)."""
    draws = drawn_features(len(limits.columns), many, seed)
    parts = []
    for tree, features in enumerate(draws):
        factor, summand = tree_factors(tree, seed)
        listed = ", ".join(map(str, features))
        parts.append(f"named_struct('tree', {tree}, 'factor', {factor}L, 'summand', {summand}L, 'features', array({listed}))")
    rows = matrix.select(*by, "label", order_key(F.col(ID)).alias("key"), limits.numbers().alias("at"))
    drawn = rows.select(*by, "label", "key", "at", F.inline(F.expr(f"array({', '.join(parts)})")))
    drawn = drawn.withColumn("times", times_drawn(F.col("key"), F.col("factor"), F.col("summand"))).where("times > 0")
    cells = drawn.select(*by, "tree", "label", "times", "at", F.explode("features").alias("feature"))
    cells = cells.select(*by, "tree", "feature", F.get("at", F.col("feature")).alias("limit"), "label", "times")
    positive = F.col("label") == 1
    return cells.groupBy(*by, "tree", "feature", "limit").agg(
        F.sum(F.when(positive, F.col("times")).otherwise(0)).alias("pos"),
        F.sum(F.when(positive, 0).otherwise(F.col("times"))).alias("neg"),
    )


def _best(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rule of each (by, tree) with the fewest errors, with its impurity decrease.

    Ties go to the first feature, the lowest limit, polarity 1.
    """
    group = [*by, "tree", "feature"]
    whole = Window.partitionBy(*group)
    ordered = whole.orderBy("limit").rowsBetween(Window.unboundedPreceding, 0)
    pos, neg = F.col("pos"), F.col("neg")
    running = cells.select(
        *group,
        "limit",
        "pos",
        "neg",
        F.sum("pos").over(ordered).alias("cum_pos"),
        F.sum("neg").over(ordered).alias("cum_neg"),
        F.sum("pos").over(whole).alias("all_pos"),
        F.sum("neg").over(whole).alias("all_neg"),
    )
    below_pos, below_neg = F.col("cum_pos") - pos, F.col("cum_neg") - neg
    above = below_pos + (F.col("all_neg") - below_neg)
    below = (F.col("all_pos") - F.col("cum_pos")) + F.col("cum_neg")

    def side(polarity: int, errors: Column, left_pos: Column, left_neg: Column) -> Column:
        return F.struct(
            errors.alias("errors"),
            F.col("feature"),
            F.col("limit"),
            F.lit(-polarity).alias("turned"),
            left_pos.alias("left_pos"),
            left_neg.alias("left_neg"),
            F.col("all_pos"),
            F.col("all_neg"),
        )

    rules = running.select(
        *by,
        "tree",
        F.explode(F.array(side(1, above, below_pos, below_neg), side(-1, below, F.col("cum_pos"), F.col("cum_neg")))).alias("rule"),
    )
    return rules.groupBy(*by, "tree").agg(F.min("rule").alias("rule")).select(*by, "tree", "rule.*")


def impurity_decrease(left_pos: int, left_neg: int, all_pos: int, all_neg: int) -> float:
    """Gini impurity of all, less that of both sides, per row."""

    def weighted(pos: int, neg: int) -> float:
        return 2.0 * pos * neg / (pos + neg) if pos + neg else 0.0

    inside = weighted(left_pos, left_neg) + weighted(all_pos - left_pos, all_neg - left_neg)
    return (weighted(all_pos, all_neg) - inside) / (all_pos + all_neg)


def _forest(rows: Iterable, limits: Limits) -> StumpForest:
    rules = []
    for r in sorted(rows, key=lambda r: r["tree"]):
        polarity = -r["turned"]
        values = limits.lows if polarity == 1 else limits.tops
        gain = impurity_decrease(r["left_pos"], r["left_neg"], r["all_pos"], r["all_neg"])
        threshold = values[r["feature"]][r["limit"]]
        drawn = r["all_pos"] + r["all_neg"], r["left_pos"] + r["left_neg"]
        rules.append(Rule(r["tree"], limits.columns[r["feature"]], threshold, polarity, r["errors"], gain, *drawn))
    return StumpForest(limits.columns, tuple(rules))


def fit_forest(matrix: DataFrame, columns: Sequence[str], many: int, seed: int, bins: int) -> StumpForest:
    """A forest of stumps on (person_id, label, columns): two passes for the limits, one for all trees.

    The driver gets ``bins`` limits per feature and one rule per tree. Rows with label 1 are positive,
    all others negative; features hold no nulls. Without rows there are no rules.
    """
    limits = Limits.fit(matrix, columns, bins)
    return _forest(_best(_cells(matrix, limits, many, seed, []), []).collect(), limits)


def fit_folds(
    matrix: DataFrame, columns: Sequence[str], folds: int, many: int, seed: int, bins: int
) -> dict[int, StumpForest]:
    """A forest per fold, trained on the rows of the others: one pass for all folds and trees.

    ``matrix`` also has ``fold``; limits are those of all rows, and come into play only where the
    training rows have a value in their range.
    """
    limits = Limits.fit(matrix, columns, bins)
    cells = _cells(matrix, limits, many, seed, ["fold"])
    listed = cells.groupBy("tree", "feature", "limit").agg(
        F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"), F.collect_list(F.struct("fold", "pos", "neg")).alias("own")
    )

    def rest(fold: Column, kind: str) -> Column:
        own = F.filter("own", lambda o: o["fold"] == fold)
        return F.col(f"all_{kind}") - F.aggregate(own, F.lit(0).cast("bigint"), lambda a, o: a + o[kind])

    each = F.transform(
        F.sequence(F.lit(0), F.lit(folds - 1)),
        lambda fold: F.struct(fold.alias("fold"), rest(fold, "pos").alias("pos"), rest(fold, "neg").alias("neg")),
    )
    others = listed.select("tree", "feature", "limit", F.inline(each))
    # A limit that only the fold itself holds has no training rows and is no candidate.
    rows = _best(others.where("pos + neg > 0"), ["fold"]).collect()
    return {fold: _forest([r for r in rows if r["fold"] == fold], limits) for fold in range(folds)}


def score_folds(matrix: DataFrame, forests: dict[int, StumpForest]) -> DataFrame:
    """Each row scored by the forest that hasn't seen it."""
    share = reduce(lambda rest, f: F.when(F.col("fold") == f[0], f[1].share()).otherwise(rest), forests.items(), F.lit(None))
    return matrix.withColumn("probability", share)


def exchanged_votes(tested: DataFrame, forest: StumpForest, seed: int) -> DataFrame:
    """Counts of (feature, probability, label) when one feature is exchanged between rows; feature '' has
    the scores as they are.

    Rows get two hash orders, and the row at a place of one takes its feature from the row at that place
    of the other. Only the votes of the exchanged feature change, so a row carries a number per feature
    and is counted at once: what is shuffled after the two orders is a count per feature and score.
    """
    parts = []
    for column in forest.columns:
        own = Counter((r.threshold, r.polarity) for r in forest.rules if r.feature == column)
        known = {(r.threshold, r.polarity): r for r in forest.rules if r.feature == column}
        parts.append(sum((F.when(known[k].holds(), n).otherwise(0) for k, n in sorted(own.items())), F.lit(0)))
    votes = tested.select(ID, "label", F.array(*parts).alias("votes"))
    donors = shuffled_rank(votes.select(ID, F.col("votes").alias("given")), order_key(F.col(ID), seed), ID)
    pairs = shuffled_rank(votes, order_key(F.col(ID)), ID).join(donors.select("position", "given"), "position")
    total = F.aggregate("votes", F.lit(0), lambda a, v: a + v)
    names = F.array(*map(F.lit, forest.columns))
    changed = F.zip_with(names, F.zip_with("votes", "given", lambda v, g: g - v), lambda n, d: F.struct(n.alias("feature"), d.alias("change")))
    same = F.array(F.struct(F.lit("").alias("feature"), F.lit(0).alias("change")))
    each = pairs.select("label", total.alias("total"), F.inline(F.concat(same, changed)))
    share = (F.col("total") + F.col("change")) / F.lit(max(1, len(forest.rules)))
    return each.groupBy("feature", share.alias("probability"), "label").agg(F.count(F.lit(1)).alias("rows"))
