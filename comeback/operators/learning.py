"""Feature matrices, scaling, classifiers and what follows from them, on Spark ML."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import (
    GBTClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from comeback.config import Settings
from comeback.functions.buckets import RISK_LABELS, risk_level
from comeback.functions.scalars import order_key, round_half_even
from comeback.operators.evaluation import precision_recall_f1, roc_auc
from comeback.operators.features import EARLY_COLUMNS, FIRST_WEEK_COLUMNS, matrix_columns
from comeback.operators.logistic import SOLVER, Logistic, fit_newton
from comeback.operators.ordered import running_totals, shuffled_rank
from comeback.operators.sampling import cross_validation_folds, train_test_split
from comeback.operators.trees import exchanged_counts, fetched_nodes, model_nodes, tree_votes

ID = "person_id"
ROWS_PER_PARTITION = 100_000
LIFETIME_COLUMNS = (
    "total_events",
    "unique_event_types",
    "active_days",
    "active_weeks",
    "tenure_days",
    "events_per_day",
    "weekly_cadence",
    "event_diversity",
    "agent_events",
    "production_events",
    "collab_events",
    "credit_events",
    "agent_ratio",
    "production_ratio",
    "collab_ratio",
    "credit_ratio",
    "ever_published_app",
    "ever_scheduled",
    "ever_shared",
    "used_addon_credits",
)
# Names of the compared models and their sizes.
LOGISTIC, FOREST, BOOSTING = "Logistic Regression", "Random Forest", "Gradient Boosting"
FOREST_TREES, UPGRADE_TREES, BOOSTING_ROUNDS = 200, 100, 150
NEWTON_STEPS = 12
#: How each compared model is fitted.
SOLVERS = {LOGISTIC: f"{SOLVER}, {NEWTON_STEPS} steps", FOREST: "trees by level", BOOSTING: "trees by level"}


def full_columns(mart: DataFrame) -> list[str]:
    """Wanted features in order, keeping those the mart has."""
    wanted = [*LIFETIME_COLUMNS, *FIRST_WEEK_COLUMNS, *matrix_columns(mart)]
    return [name for name in wanted if name in mart.columns]


def feature_matrix(mart: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Person, label and the features as doubles, nulls as 0."""
    return mart.select(
        ID, F.col(label).alias("label"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]
    )


@dataclass(frozen=True)
class Scaler:
    """Population mean and deviation per column; a constant column keeps the divisor 1."""

    columns: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]
    rows: int

    @classmethod
    def fit(cls, frame: DataFrame, columns: Sequence[str]) -> Scaler:
        """One pass; the result is the row count and two numbers per column."""
        stats = [f(c) for f in (F.avg, F.stddev_pop) for c in columns]
        rows, *values = frame.agg(F.count(F.lit(1)), *stats).first()
        means, deviations = values[: len(columns)], values[len(columns) :]
        return cls(tuple(columns), tuple(m or 0.0 for m in means), tuple(d or 1.0 for d in deviations), rows)

    def scaled(self) -> list[Column]:
        return [
            ((F.col(c) - F.lit(m)) / F.lit(d)).alias(c)
            for c, m, d in zip(self.columns, self.means, self.deviations)
        ]

    def stage(self) -> SQLTransformer:
        """The same arithmetic as a savable pipeline stage; scaled columns are ``z0``, ``z1``, ..."""
        parts = [
            f"(`{c}` - ({m!r}D)) / {d!r}D AS z{i}"
            for i, (c, m, d) in enumerate(zip(self.columns, self.means, self.deviations))
        ]
        return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def stable_layout(frame: DataFrame, rows: int) -> DataFrame:
    """Rows placed and ordered by person, so that seeded training repeats under any input layout.

    The number of partitions follows the data, as every iteration runs one task for each.
    """
    parts = max(1, math.ceil(rows / ROWS_PER_PARTITION))
    return frame.repartition(parts, ID).sortWithinPartitions(ID)


def forest(trees: int, depth: int, seed: int, bins: int = Settings.tree_bins) -> RandomForestClassifier:
    """Bootstrapped trees over sqrt(p) features per node; ``bins`` candidate limits per feature."""
    return RandomForestClassifier(
        numTrees=trees, maxDepth=depth, maxBins=bins, featureSubsetStrategy="sqrt", bootstrap=True, seed=seed
    )


def stump_forest(trees: int, seed: int, bins: int = Settings.tree_bins) -> RandomForestClassifier:
    return forest(trees, 1, seed, bins)


def fit_classifier(train: DataFrame, columns: Sequence[str], estimator: Estimator) -> PipelineModel:
    """Scale on the training rows only, assemble, fit."""
    scaler = Scaler.fit(train, columns)
    prepare = [
        scaler.stage(),
        VectorAssembler(inputCols=[f"z{i}" for i in range(len(columns))], outputCol="features"),
    ]
    ready = PipelineModel(prepare).transform(train).select(ID, F.col("label").cast("double"), "features")
    ready = stable_layout(ready, scaler.rows).persist()
    try:
        return PipelineModel([*prepare, estimator.fit(ready)])
    finally:
        ready.unpersist()


def score(model: PipelineModel, frame: DataFrame) -> DataFrame:
    """Add ``probability`` of class 1 and ``prediction``; forests vote, a tie is class 0."""
    classifier = model.stages[-1]
    scored = PipelineModel(model.stages[:-1]).transform(frame)
    if isinstance(classifier, RandomForestClassificationModel):
        nodes = model_nodes(frame.sparkSession, classifier)
        scored = tree_votes(scored, vector_to_array("features"), nodes, classifier.getOrDefault("maxDepth"))
    else:
        scored = classifier.transform(scored).withColumns(
            {"probability": vector_to_array("probability")[1], "prediction": F.col("prediction").cast("int")}
        )
    return scored.select(*frame.columns, "probability", "prediction")


def fit_and_score(
    mart: DataFrame, columns: Sequence[str], label: str, estimator: Estimator | None, settings: Settings
) -> tuple[PipelineModel | NewtonModel, DataFrame]:
    """Train on the stratified training split; return the model and the scored test split.

    Without an estimator the model is logistic, by Newton steps."""
    split = train_test_split(feature_matrix(mart, columns, label), settings, "label")
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'")
    model = fit_logistic(train, columns) if estimator is None else fit_classifier(train, columns, estimator)
    tested = model.score(test) if estimator is None else score(model, test)
    return model, tested.select(ID, "label", "probability", "prediction", "split")


@dataclass(frozen=True)
class NewtonModel:
    """A scaler of the training rows and the logistic model on its columns."""

    scaler: Scaler
    fitted: Logistic

    def score(self, frame: DataFrame) -> DataFrame:
        scaled = frame.select("*", *[z.alias(f"_z{i}") for i, z in enumerate(self.scaler.scaled())])
        return self.fitted.score(scaled).select(*frame.columns, "probability", "prediction")


def fit_logistic(train: DataFrame, columns: Sequence[str], steps: int = NEWTON_STEPS, penalty: float = 1.0) -> NewtonModel:
    """Scale on the training rows only, then a fixed number of Newton steps."""
    scaler = Scaler.fit(train, columns)
    names = [f"_z{i}" for i in range(len(columns))]
    ready = train.select("label", *[z.alias(n) for n, z in zip(names, scaler.scaled(), strict=True)]).persist()
    try:
        return NewtonModel(scaler, fit_newton(ready, names, steps, penalty))
    finally:
        ready.unpersist()


def comparison_models(settings: Settings) -> dict[str, Estimator | None]:
    """The three compared classifiers; None is ``fit_logistic``, all others are fitted by Spark ML."""
    return {
        LOGISTIC: None,
        FOREST: forest(FOREST_TREES, settings.forest_depth, settings.seed, settings.tree_bins),
        BOOSTING: GBTClassifier(
            maxIter=BOOSTING_ROUNDS, maxDepth=settings.boosting_depth, maxBins=settings.tree_bins, seed=settings.seed
        ),
    }


def union_scored(scored: Iterable[tuple[str, DataFrame]]) -> DataFrame:
    """Scored rows of several models, told apart by ``model``."""
    return reduce(DataFrame.unionByName, [rows.withColumn("model", F.lit(name)) for name, rows in scored])


def compare_models(scored: DataFrame) -> DataFrame:
    """Confusion counts, rates and AUC of every model, side by side."""
    rates = precision_recall_f1(scored, ["model"])
    area = roc_auc(scored, ["model"]).withColumn("auc", round_half_even(F.col("auc"), 4))
    return rates.join(F.broadcast(area), "model").orderBy("model")


def cross_validated_auc(
    mart: DataFrame,
    columns: Sequence[str],
    label: str,
    estimator: Estimator,
    settings: Settings,
    stage: Callable[[str, DataFrame], DataFrame],
) -> DataFrame:
    """AUC per fold; ``stage`` stores the folded matrix and the scored folds between the fits."""
    matrix = stage("folds", cross_validation_folds(feature_matrix(mart, columns, label), "label", settings.folds))
    held_out = []
    for fold in range(settings.folds):
        model = fit_classifier(matrix.filter(F.col("fold") != fold), columns, estimator)
        held_out.append(score(model, matrix.filter(F.col("fold") == fold)).select("fold", "label", "probability"))
    return roc_auc(stage("fold_scores", reduce(DataFrame.unionByName, held_out)), ["fold"]).orderBy("fold")


def auc_interval(folds: DataFrame) -> DataFrame:
    """Mean, population deviation and 95 % interval over the folds."""
    stats = folds.agg(F.avg("auc").alias("mean"), F.stddev_pop("auc").alias("std"))
    return stats.select(
        round_half_even(F.col("mean"), 4).alias("mean_auc"),
        round_half_even(F.col("std"), 4).alias("std_auc"),
        round_half_even(F.col("mean") - 1.96 * F.col("std"), 4).alias("ci_lo"),
        round_half_even(F.col("mean") + 1.96 * F.col("std"), 4).alias("ci_hi"),
    )


def feature_importance(model: PipelineModel, columns: Sequence[str], limit: int = 15) -> DataFrame:
    """The ``limit`` features with the highest impurity importance."""
    weights = [float(w) for w in model.stages[-1].featureImportances.toArray()]
    table = SparkSession.active().createDataFrame(
        list(zip(columns, weights)), "feature string, importance double"
    )
    return table.orderBy(F.desc("importance"), "feature").limit(limit)


def permutation_importance(
    model: PipelineModel,
    tested: DataFrame,
    columns: Sequence[str],
    settings: Settings,
    stage: Callable[[str, DataFrame], DataFrame],
) -> DataFrame:
    """AUC lost when one feature is exchanged between rows, for all features in one scoring pass.

    ``stage`` stores how many rows of each label have which score, which the AUC reads several times.

    Rows get two independent hash orders; the row at position i of one takes its values from
    the row at position i of the other. Each row is then scored once per feature with only that
    feature exchanged: forests do so where the row stands, for other models it appears so often.
    """
    here = order_key(F.col(ID))
    there = order_key(F.col(ID), settings.seed)
    classifier = model.stages[-1]
    if isinstance(classifier, RandomForestClassificationModel):
        ready = PipelineModel(model.stages[:-1]).transform(tested).select(ID, "label", vector_to_array("features").alias("values"))
        base = shuffled_rank(ready, here, ID).select("position", "label", "values")
        donors = shuffled_rank(ready.select(ID, "values"), there, ID).select("position", F.col("values").alias("donor"))
        nodes = fetched_nodes(tested.sparkSession, classifier)
        counts = exchanged_counts(base.join(donors, "position"), len(columns), nodes, classifier.getOrDefault("maxDepth"))
        name = F.when(F.col("feature") < 0, "").otherwise(F.get(F.array(*map(F.lit, columns)), F.col("feature")))
        return auc_losses(stage("permuted", counts.select(name.alias("feature"), "probability", "label", "rows")))

    base = shuffled_rank(tested, here, ID)
    donors = shuffled_rank(tested.select(ID, *columns), there, ID)
    donors = donors.select("position", F.struct(*columns).alias("donor"))
    variants = F.explode(F.array(F.lit(""), *[F.lit(c) for c in columns])).alias("feature")
    exchanged = (
        base.join(donors, "position")
        .select("label", "donor", *columns, variants)
        .select(
            "label",
            "feature",
            *[F.when(F.col("feature") == c, F.col(f"donor.{c}")).otherwise(F.col(c)).alias(c) for c in columns],
        )
    )
    scored = score(model, exchanged).groupBy("feature", "probability", "label").agg(F.count(F.lit(1)).alias("rows"))
    return auc_losses(stage("permuted", scored))


def auc_losses(scored: DataFrame) -> DataFrame:
    """AUC lost per feature from counts of (feature, probability, label), those of feature '' being the
    scores with nothing exchanged."""
    areas = roc_auc(scored, ["feature"], "rows")
    original = areas.filter("feature = ''").select(F.col("auc").alias("base_auc"))
    lost = areas.filter("feature <> ''").crossJoin(F.broadcast(original))
    return lost.select(
        "feature", round_half_even(F.col("base_auc") - F.col("auc"), 6).alias("auc_loss")
    ).orderBy(F.desc("auc_loss"), "feature")


def best_stump(matrix: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """The one-feature rule with the fewest errors over all features, thresholds and directions.

    Polarity 1 predicts 1 at or above the threshold, polarity -1 at or below it. Ties go to the
    first feature, the lowest threshold, polarity 1. With ``weight``, errors are sums of that column,
    taken in whole billionths so that they are exact in any order (up to 9e9 in all); a null weighs
    nothing, and rows that weigh nothing still offer their values as thresholds.
    """
    entries = [
        F.struct(F.lit(i).alias("feature_no"), F.lit(c).alias("feature"), F.col(c).cast("double").alias("threshold"))
        for i, c in enumerate(columns)
    ]
    positive = F.col("label") == 1
    unit = 1 if weight is None else 10**9
    weighs = F.lit(1) if weight is None else F.coalesce((F.col(weight).cast("decimal(20,9)") * unit).cast("bigint"), F.lit(0))

    def total(test: Column) -> Column:
        return F.sum(F.when(test, F.col("_weight")).otherwise(0))

    rows = matrix.withColumn("_weight", weighs)
    counts = (
        rows.select("label", "_weight", F.inline(F.array(*entries)))
        .groupBy("feature_no", "feature", "threshold")
        .agg(total(positive).alias("pos"), total(~positive).alias("neg"))
    )
    running = running_totals(counts, "threshold", ["pos", "neg"], ["feature_no", "feature"])
    totals = rows.agg(total(positive).alias("all_pos"), total(~positive).alias("all_neg"))
    pos, neg = F.col("pos"), F.col("neg")
    above = (F.col("cum_pos") - pos) + (F.col("all_neg") - F.col("cum_neg") + neg)
    below = (F.col("all_pos") - F.col("cum_pos")) + F.col("cum_neg")
    rules = running.crossJoin(F.broadcast(totals)).select(
        "feature_no",
        "feature",
        "threshold",
        (F.col("all_pos") + F.col("all_neg")).alias("rows"),
        F.inline(
            F.array(
                F.struct(F.lit(1).alias("polarity"), above.alias("errors")),
                F.struct(F.lit(-1).alias("polarity"), below.alias("errors")),
            )
        ),
    )
    best = rules.orderBy("errors", "feature_no", "threshold", F.desc("polarity")).limit(1)
    errors = F.col("errors") if weight is None else (F.col("errors") / unit).alias("errors")
    error = round_half_even(F.when(F.col("rows") > 0, F.col("errors") / F.col("rows")).otherwise(0.0), 6).alias("error")
    return best.select("feature", "threshold", "polarity", errors, error)


def risk_scores(model: PipelineModel, mart: DataFrame, settings: Settings) -> DataFrame:
    """Every person scored with the early model, with risk level."""
    matrix = feature_matrix(mart, EARLY_COLUMNS, "is_successful")
    return with_risk(score(model, matrix), settings)


def with_risk(scored: DataFrame, settings: Settings) -> DataFrame:
    """Person, probability and risk level."""
    named = scored.withColumnRenamed("probability", "success_probability")
    return named.select(
        ID, "success_probability", risk_level(F.col("success_probability"), settings).alias("risk_flag")
    )


def risk_distribution(risks: DataFrame) -> DataFrame:
    return risks.groupBy("risk_flag").agg(F.count(F.lit(1)).alias("users")).orderBy(F.desc("users"), "risk_flag")


def business_case(risks: DataFrame, by_milestones: DataFrame, upgrades: DataFrame, settings: Settings) -> DataFrame:
    """High-risk users, recovery rate between few and many milestones, estimated recoveries.

    All inputs but ``risks`` are report rows; an absent milestone-0 group counts as rate 0.
    """
    high = risks.agg(F.count_if(F.col("risk_flag") == RISK_LABELS[0]).alias("high_risk_users"))
    many = F.avg(F.when(F.col("milestones_hit") >= settings.recovery_milestones, F.col("success_rate")))
    none = F.coalesce(F.max(F.when(F.col("milestones_hit") == 0, F.col("success_rate"))), F.lit(0.0))
    recovery = by_milestones.agg(((many - none) / 100).alias("recovery_rate"))
    joined = high.crossJoin(F.broadcast(recovery)).crossJoin(F.broadcast(upgrades))
    recoveries = F.col("high_risk_users") * F.col("recovery_rate") * settings.recovery_share
    return joined.select(
        "high_risk_users",
        round_half_even(F.col("recovery_rate"), 6).alias("recovery_rate"),
        recoveries.cast("bigint").alias("estimated_recoveries"),
        F.col("candidates").alias("upgrade_candidates"),
        F.col("pct").alias("upgrade_pct"),
    )
