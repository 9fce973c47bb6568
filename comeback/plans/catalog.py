"""Named queries over the driver's tables."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.ml.base import Estimator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comeback.functions.scalars import round_half_even
from comeback.operators import activity as act
from comeback.operators import (
    boosting,
    cleaning,
    cohorts,
    evaluation,
    features,
    funnel,
    learning,
    rates,
    sampling,
    segments,
    stumps,
    trees,
    trends,
)
from comeback.operators.scoring import success_summary
from comeback.plans.testlog import TEST_SETTINGS, dirty_event_log, event_log
from comeback.plans.workspace import Workspace
from comeback.sources.events import dataset_profile, head_rows, read_events
from comeback.sources.storage import write_report

Query = Callable[[SparkSession, str], DataFrame]

_workspaces: dict[tuple[str, str], Workspace] = {}
_guard = threading.Lock()


def workspace(spark: SparkSession, folder: str) -> Workspace:
    """One workspace per application and input folder; its tables are built on first use."""
    key = (spark.sparkContext.applicationId, folder)
    with _guard:
        if key not in _workspaces:
            _workspaces[key] = Workspace(spark, event_log(spark, folder), TEST_SETTINGS)
        return _workspaces[key]


def on_workspace(report: Callable[[Workspace], DataFrame]) -> Query:
    return lambda spark, folder: report(workspace(spark, folder))


def _dirty(spark: SparkSession, folder: str) -> DataFrame:
    return dirty_event_log(spark, folder)


def _clean(spark: SparkSession, folder: str) -> DataFrame:
    events = cleaning.clean_events(_dirty(spark, folder), TEST_SETTINGS)
    return events.select(
        "uuid",
        "person_id",
        "event",
        F.col("timestamp").cast("timestamp_ntz").alias("event_time"),
        F.col("`prop_$os`").alias("os"),
        "date",
        "hour",
        "dow",
        "week",
        "month",
    )


def _flags(spark: SparkSession, folder: str) -> DataFrame:
    taxonomy = TEST_SETTINGS.taxonomy
    flagged = cleaning.add_flags(event_log(spark, folder), taxonomy)
    names = [f"is_{kind}_event" for kind in taxonomy.categories()]
    other = cleaning.in_no_category(taxonomy).cast("int").alias("is_other")
    return flagged.select("uuid", "event", *names, "is_signup", other)


def _offsets(spark: SparkSession, folder: str) -> DataFrame:
    events = cleaning.clean_events(event_log(spark, folder), TEST_SETTINGS)
    placed = act.event_offsets(events, act.first_activity(events), TEST_SETTINGS)
    return placed.select("uuid", "person_id", "days_since_first", "weeks_since_first")


def _user_features(ws: Workspace) -> DataFrame:
    counts = [f"{kind}_events" for kind in TEST_SETTINGS.taxonomy.categories()]
    shares = [f"{kind}_ratio" for kind in TEST_SETTINGS.taxonomy.categories()]
    return ws.mart.select(
        "person_id",
        "total_events",
        "unique_event_types",
        F.col("first_seen").cast("timestamp_ntz").alias("first_seen"),
        F.col("last_seen").cast("timestamp_ntz").alias("last_seen"),
        "active_days",
        "active_weeks",
        *counts,
        "tenure_days",
        *[
            round_half_even(F.col(c), 6).alias(c)
            for c in ["events_per_day", *shares, "event_diversity", "weekly_cadence"]
        ],
        "ever_published_app",
        "ever_scheduled",
        "ever_shared",
        "used_addon_credits",
        "is_upgrade_candidate",
    )


def _first_time(column: str, hours: str, bucket: str) -> Query:
    return on_workspace(
        lambda ws: ws.mart.select(
            "person_id",
            F.col(column).cast("timestamp_ntz").alias(column),
            round_half_even(F.col(hours), 6).alias(hours),
            bucket,
        )
    )


def _scores(ws: Workspace) -> DataFrame:
    names = ["retention_score", "depth_score", "volume_score", "success_score"]
    return ws.mart.select("person_id", *[round_half_even(F.col(c), 6).alias(c) for c in names], "is_successful")


def _retention(ws: Workspace) -> DataFrame:
    return cohorts.cohort_retention(ws.weeks, ws.people, ws.settings)


def _weekly(kind: str, alias: str) -> Query:
    def names(ws: Workspace) -> tuple[str, ...]:
        taxonomy = ws.settings.taxonomy
        return {"agent": taxonomy.agent, "signup": taxonomy.signup, "created": (taxonomy.account_created,)}[kind]

    return on_workspace(lambda ws: trends.weekly_events(ws.activity, names(ws), alias))


def _read_log(spark: SparkSession, folder: str) -> DataFrame:
    """The log written as a wide Parquet table and read by the contract."""
    ws = workspace(spark, folder)
    path = f"{ws.folder}/log"
    wide = ws.raw.withColumn("created_at", F.col("timestamp"))
    ws.once("log", lambda: wide.write.mode("overwrite").parquet(path))
    log = read_events(spark, path)
    return log.select("uuid", "person_id", "event", F.col("timestamp").cast("timestamp_ntz").alias("event_time"), F.col("`prop_$os`").alias("os"))


def _stored_report(spark: SparkSession, folder: str) -> DataFrame:
    """A report as it is read back from storage."""
    ws = workspace(spark, folder)
    report = rates.success_by_agent_speed(ws.mart)
    path = ws.once("report", lambda: write_report(report, f"{ws.folder}/reports", "agent_speed"))
    return spark.read.parquet(path)


def _narrow_funnel(spark: SparkSession, folder: str) -> DataFrame:
    """The funnel of a workspace whose event matrix holds three names only."""
    wide = workspace(spark, folder)
    narrow = wide.once("narrow", lambda: Workspace(spark, wide.raw, replace(TEST_SETTINGS, top_events=3)))
    return funnel.user_funnel(narrow.mart, narrow.settings)


RELATIONAL: dict[str, Query] = {
    "dataset_profile": lambda spark, folder: dataset_profile(_dirty(spark, folder)),
    "clean_events": _clean,
    "dedupe_report": lambda spark, folder: cleaning.dedupe_report(_dirty(spark, folder)),
    "event_flags": _flags,
    "event_offsets": _offsets,
    "event_frequency": on_workspace(lambda ws: features.event_frequency(ws.activity)),
    "top_events": on_workspace(lambda ws: features.event_frequency(ws.activity).limit(15)),
    "category_breakdown": on_workspace(lambda ws: trends.category_breakdown(ws.activity, ws.settings.taxonomy)),
    "weekly_events": on_workspace(lambda ws: trends.weekly_events(ws.activity)),
    "weekly_active_users": on_workspace(lambda ws: trends.weekly_active_users(ws.weeks, ws.settings)),
    "weekly_signups": _weekly("signup", "signups"),
    "weekly_new_accounts": _weekly("created", "signups"),
    "weekly_agent_events": _weekly("agent", "events"),
    "hourly_events": on_workspace(lambda ws: trends.hourly_events(ws.activity)),
    "weekday_events": on_workspace(lambda ws: trends.weekday_events(ws.activity)),
    "os_distribution": on_workspace(lambda ws: trends.os_distribution(ws.activity)),
    "user_features": on_workspace(_user_features),
    "first_week_features": on_workspace(
        lambda ws: ws.mart.select("person_id", *[c for c in ws.mart.columns if c.startswith("fw_")])
    ),
    "day3_features": on_workspace(lambda ws: ws.mart.select("person_id", *features.EARLY_COLUMNS)),
    "user_event_matrix": on_workspace(
        lambda ws: ws.mart.select("person_id", *sorted(features.matrix_columns(ws.mart)))
    ),
    "user_os_mode": on_workspace(lambda ws: ws.mart.select("person_id", "os_platform")),
    "first_event": on_workspace(lambda ws: ws.mart.select("person_id", "first_event")),
    "signup_hour": on_workspace(lambda ws: ws.mart.select("person_id", "signup_hour", "signup_period")),
    "user_milestones": on_workspace(
        lambda ws: ws.mart.select("person_id", *features.MILESTONES, "milestones_hit")
    ),
    "first_agent_time": _first_time("first_agent_ts", "hours_to_first_agent", "agent_speed"),
    "first_value_time": _first_time("first_value_ts", "hours_to_first_value", "ttv_bucket"),
    "user_scores": on_workspace(_scores),
    "success_summary": on_workspace(lambda ws: success_summary(ws.mart)),
    "success_by_agent_speed": on_workspace(lambda ws: rates.success_by_agent_speed(ws.mart)),
    "success_by_time_to_value": on_workspace(lambda ws: rates.success_by_time_to_value(ws.mart)),
    "success_by_milestones": on_workspace(lambda ws: rates.success_by_milestones(ws.mart)),
    "milestone_lift": on_workspace(lambda ws: rates.milestone_lift(ws.mart)),
    "milestone_upgrade_lift": on_workspace(lambda ws: rates.milestone_lift(ws.mart, "is_upgrade_candidate")),
    "success_by_first_event": on_workspace(lambda ws: rates.success_by_first_event(ws.mart, ws.settings)),
    "success_by_os": on_workspace(lambda ws: rates.success_by_os(ws.mart, ws.settings)),
    "success_by_signup_period": on_workspace(lambda ws: rates.success_by_signup_period(ws.mart)),
    "success_by_first_week_days": on_workspace(lambda ws: rates.success_by_first_week_days(ws.mart)),
    "sharing_effect": on_workspace(lambda ws: rates.sharing_effect(ws.mart)),
    "publish_effect": on_workspace(lambda ws: rates.publish_effect(ws.mart)),
    "publish_contingency": on_workspace(lambda ws: rates.publish_contingency(ws.mart)),
    "upgrade_candidates": on_workspace(lambda ws: rates.upgrade_candidates(ws.mart)),
    "one_time_visitors": on_workspace(lambda ws: rates.one_time_visitors(ws.mart, ws.settings)),
    "feature_means_by_label": on_workspace(
        lambda ws: rates.feature_means_by_label(ws.mart, rates.LIFETIME_COMPARISON)
    ),
    "first_week_means_by_label": on_workspace(
        lambda ws: rates.feature_means_by_label(ws.mart, rates.FIRST_WEEK_COMPARISON)
    ),
    "score_histogram": on_workspace(lambda ws: rates.score_histogram(ws.mart)),
    "agent_histogram_by_label": on_workspace(lambda ws: rates.agent_histogram(ws.mart)),
    "volume_correlation": on_workspace(lambda ws: rates.volume_correlation(ws.mart)),
    "cohort_sizes": on_workspace(lambda ws: cohorts.cohort_sizes(ws.people, ws.settings)),
    "cohort_retention": on_workspace(_retention),
    "cohort_matrix": on_workspace(lambda ws: cohorts.cohort_matrix(_retention(ws), ws.settings)),
    "avg_retention_curve": on_workspace(lambda ws: cohorts.average_retention_curve(_retention(ws))),
    "avg_retention_curve_dense": on_workspace(
        lambda ws: cohorts.average_retention_curve(_retention(ws), dense=True)
    ),
    "retention_cliff": on_workspace(
        lambda ws: cohorts.retention_cliff(cohorts.average_retention_curve(_retention(ws)))
    ),
    "survival_curve": on_workspace(lambda ws: cohorts.survival_curve(ws.mart, ws.settings)),
    "daily_cumulative_events": on_workspace(
        lambda ws: cohorts.daily_cumulative_events(ws.activity, ws.mart, ws.settings)
    ),
    "top_20_events": on_workspace(lambda ws: features.event_frequency(ws.activity).limit(20)),
    "top_30_events": on_workspace(lambda ws: features.event_frequency(ws.activity).limit(30)),
    "score_histogram_dense": on_workspace(lambda ws: rates.score_histogram(ws.mart, dense=True)),
    "volume_points": on_workspace(lambda ws: rates.volume_points(ws.mart)),
    "retention_depth_points": on_workspace(lambda ws: rates.retention_depth_points(ws.mart)),
    "read_log": _read_log,
    "log_head": lambda spark, folder: head_rows(_read_log(spark, folder)),
    "stored_report": _stored_report,
    "user_funnel_of_3_names": _narrow_funnel,
    "user_funnel": on_workspace(lambda ws: funnel.user_funnel(ws.mart, ws.settings)),
    "headline_numbers": on_workspace(lambda ws: rates.headline_numbers(ws.mart, ws.settings)),
    "funnel_dropoff": on_workspace(lambda ws: funnel.funnel_dropoff(funnel.user_funnel(ws.mart, ws.settings))),
}


def _scored_by_ratio(ws: Workspace) -> DataFrame:
    """A deterministic score for the evaluation queries: share of early agent events."""
    ratio = F.col("d3_agent_events") / (F.col("d3_total_events") + 1)
    scored = ws.mart.select("person_id", F.col("is_successful").alias("label"), ratio.alias("probability"))
    return scored.withColumn("prediction", (F.col("probability") > 0.3).cast("int"))


def _rounded(frame: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return frame.withColumns({c: round_half_even(F.col(c), digits) for c in columns})


def _feature_matrix(ws: Workspace) -> DataFrame:
    columns = learning.full_columns(ws.mart)
    matrix = learning.feature_matrix(ws.mart, columns, "is_successful")
    return _rounded(matrix, *columns)


def _zscores(ws: Workspace) -> DataFrame:
    return _rounded(segments.standardised(ws.mart), *segments.CLUSTER_COLUMNS)


def _split(ws: Workspace) -> DataFrame:
    people = ws.mart.select("person_id", F.col("is_successful").alias("label"))
    return sampling.train_test_split(people, ws.settings, "label")


def _plain_split(ws: Workspace) -> DataFrame:
    return sampling.train_test_split(ws.mart.select("person_id"), ws.settings)


def _sample(ws: Workspace) -> DataFrame:
    return sampling.stratified_sample(ws.mart.select("person_id", "is_successful"), "is_successful", 200)


def _folds(ws: Workspace) -> DataFrame:
    people = ws.mart.select("person_id", F.col("is_successful").alias("label"))
    return sampling.cross_validation_folds(people, "label", ws.settings.folds)


def _lloyd(ws: Workspace) -> DataFrame:
    scaled = segments.standardised(ws.mart)
    step = segments.lloyd_step(scaled, segments.seed_centres(scaled, 4))
    return _rounded(step, "inertia", *segments.CLUSTER_COLUMNS)


def _weighted_stump(ws: Workspace) -> DataFrame:
    """Persons with fewer events weigh more, every seventh nothing."""
    matrix = learning.feature_matrix(ws.mart, features.EARLY_COLUMNS, "is_successful")
    weight = F.when(F.col("person_id") % 7 == 0, 0.0).otherwise(1 / (F.col("d3_total_events") + 1))
    return learning.best_stump(matrix.withColumn("weight", weight), features.EARLY_COLUMNS, "weight")


def _stump(ws: Workspace) -> DataFrame:
    matrix = learning.feature_matrix(ws.mart, features.EARLY_COLUMNS, "is_successful")
    return learning.best_stump(matrix, features.EARLY_COLUMNS)


RELATIONAL.update(
    {
        "feature_matrix": on_workspace(_feature_matrix),
        "zscore_features": on_workspace(_zscores),
        "stratified_split": on_workspace(_split),
        "random_split": on_workspace(_plain_split),
        "stratified_sample": on_workspace(_sample),
        "simple_sample": on_workspace(lambda ws: sampling.simple_sample(ws.mart.select("person_id"), 300)),
        "cv_folds": on_workspace(_folds),
        "lloyd_step": on_workspace(_lloyd),
        "best_stump": on_workspace(_stump),
        "best_stump_weighted": on_workspace(_weighted_stump),
        "roc_points": on_workspace(
            lambda ws: _rounded(evaluation.roc_points(_scored_by_ratio(ws)), "threshold", "fpr", "tpr")
        ),
        "roc_auc": on_workspace(lambda ws: _rounded(evaluation.roc_auc(_scored_by_ratio(ws)), "auc")),
        "confusion": on_workspace(lambda ws: evaluation.confusion(_scored_by_ratio(ws))),
        "precision_recall_f1": on_workspace(lambda ws: evaluation.precision_recall_f1(_scored_by_ratio(ws))),
        "threshold_sweep": on_workspace(lambda ws: evaluation.threshold_sweep(_scored_by_ratio(ws))),
        "selected_thresholds": on_workspace(
            lambda ws: evaluation.selected_thresholds(evaluation.threshold_sweep(_scored_by_ratio(ws)))
        ),
        "classification_report": on_workspace(lambda ws: evaluation.classification_report(_scored_by_ratio(ws))),
    }
)


# Model reports on scores and centres that plain SQL can restate.


def _three_scores(ws: Workspace) -> DataFrame:
    """Early agent share, early production share, early active days."""
    label = F.col("is_successful").alias("label")
    scores = {
        "agent": F.col("d3_agent_events") / (F.col("d3_total_events") + 1),
        "production": F.col("d3_production_events") / (F.col("d3_total_events") + 1),
        "days": F.col("d3_active_days") / 4,
    }
    plans = [ws.mart.select("person_id", label, p.alias("probability"), F.lit(n).alias("model")) for n, p in scores.items()]
    union = plans[0].unionAll(plans[1]).unionAll(plans[2])
    return union.withColumn("prediction", (F.col("probability") > 0.3).cast("int"))


def _best_of_three(ws: Workspace) -> DataFrame:
    scored = _three_scores(ws)
    best = evaluation.best_model(learning.compare_models(scored)).first()["model"]
    return evaluation.classification_report(scored.filter(F.col("model") == best)).withColumn("model", F.lit(best))


def _ratio_folds(ws: Workspace) -> DataFrame:
    folded = sampling.cross_validation_folds(_scored_by_ratio(ws), "label", ws.settings.folds)
    return evaluation.roc_auc(folded, ["fold"])


def _ratio_risks(ws: Workspace) -> DataFrame:
    return learning.with_risk(_scored_by_ratio(ws), ws.settings)


def _centred(ws: Workspace) -> DataFrame:
    return ws.staged("centred", lambda: segments.centre_segments(ws.mart))


RELATIONAL.update(
    {
        "centre_segments": on_workspace(lambda ws: _centred(ws).select("person_id", "cluster", "segment")),
        "centre_elbow": on_workspace(lambda ws: segments.centre_elbow(ws.mart)),
        "centre_segment_success": on_workspace(
            lambda ws: _rounded(segments.segment_success(_centred(ws)), "avg_events", "avg_tenure")
        ),
        "centre_segment_sizes": on_workspace(lambda ws: segments.segment_sizes(_centred(ws))),
        "centre_segment_profile": on_workspace(lambda ws: segments.segment_profile(_centred(ws))),
        "centre_cluster_profile": on_workspace(lambda ws: segments.segment_profile(_centred(ws), "cluster")),
        "centre_segment_radar": on_workspace(
            lambda ws: _rounded(segments.segment_radar(_centred(ws)), *segments.RADAR_COLUMNS)
        ),
        "centre_segment_upgrade": on_workspace(lambda ws: segments.segment_upgrade(_centred(ws))),
        "ratio_model_evaluation": on_workspace(lambda ws: learning.compare_models(_three_scores(ws))),
        "ratio_roc_curves": on_workspace(
            lambda ws: _rounded(evaluation.roc_points(_three_scores(ws), ["model"]), "threshold", "fpr", "tpr")
        ),
        "ratio_best_report": on_workspace(_best_of_three),
        "ratio_fold_auc": on_workspace(lambda ws: _rounded(_ratio_folds(ws), "auc")),
        "ratio_fold_interval": on_workspace(lambda ws: learning.auc_interval(_ratio_folds(ws))),
        "ratio_risks": on_workspace(_ratio_risks),
        "ratio_risk_distribution": on_workspace(lambda ws: learning.risk_distribution(_ratio_risks(ws))),
        "ratio_business_case": on_workspace(
            lambda ws: learning.business_case(
                _ratio_risks(ws), rates.success_by_milestones(ws.mart), rates.upgrade_candidates(ws.mart), ws.settings
            )
        ),
    }
)


# Models: fitted once per workspace; their scored test rows are staged.


def _clusters(ws: Workspace) -> dict[int, segments.Run]:
    return ws.once("clusters", lambda: segments.fit_clusters(ws.mart, ws.settings.seed))


def _personas(ws: Workspace) -> segments.Personas:
    return ws.once("personas", lambda: segments.fit_personas(ws.mart, _clusters(ws)[len(segments.PERSONAS)]))


def _segmented(ws: Workspace) -> DataFrame:
    """The mart with cluster, segment and components."""

    def build() -> DataFrame:
        return _personas(ws).assign(segments.on_grid(segments.standardised(ws.mart)))

    return ws.staged("segmented", lambda: ws.mart.join(ws.staged("segments", build), "person_id"))


def _compared(ws: Workspace) -> dict[str, Estimator | None]:
    return learning.comparison_models(ws.settings)


def _comparison(ws: Workspace) -> DataFrame:
    """The compared models side by side, and how each was fitted."""
    pairs = [F.lit(part) for pair in learning.SOLVERS.items() for part in pair]
    solver = F.element_at(F.create_map(*pairs), F.col("model")).alias("solver")
    return _side_by_side(ws, _compared(ws)).select("*", solver)


def _boosted(ws: Workspace, name: str, rounds: int) -> DataFrame:
    """The scored test split of boosted stumps."""

    def build() -> DataFrame:
        split = _split_matrix(ws, name)
        model = boosting.fit_boosted(split.filter("split = 'train'"), _columns_of(ws, name), rounds, ws.settings.tree_bins)
        tested = model.score(split.filter("split = 'test'"))
        return tested.select("person_id", "label", "probability", "prediction")

    return ws.staged(f"boosted_{name}_{rounds}", build)


def _newton(ws: Workspace) -> DataFrame:
    """Intercept (feature '') and coefficients on scaled early features after three steps."""

    def build() -> DataFrame:
        train = _split_matrix(ws, "early").filter("split = 'train'")
        fitted = learning.fit_logistic(train, features.EARLY_COLUMNS, steps=3).fitted
        return replace(fitted, columns=tuple(features.EARLY_COLUMNS)).table(ws.spark)

    return ws.once("newton", build)


def _vote_permutation(ws: Workspace) -> DataFrame:
    def build() -> DataFrame:
        tested = _split_matrix(ws, "full").filter("split = 'test'")
        return stumps.exchanged_votes(tested, _forest(ws, "full"), ws.settings.seed)

    return learning.auc_losses(ws.staged("vote_permutation", build))


def _full_columns(ws: Workspace) -> list[str]:
    """The full model's features, those of the event matrix by name."""
    return sorted(learning.full_columns(ws.mart), key=lambda c: c if c.startswith("evt_") else "")


#: Forests of stumps: label and number of trees.
STUMPS = {
    "full": ("is_successful", learning.FOREST_TREES),
    "early": ("is_successful", learning.FOREST_TREES),
    "upgrade": ("is_upgrade_candidate", learning.UPGRADE_TREES),
}


def _columns_of(ws: Workspace, name: str) -> list[str]:
    return _full_columns(ws) if name == "full" else list(features.EARLY_COLUMNS)


def _split_matrix(ws: Workspace, name: str) -> DataFrame:
    def build() -> DataFrame:
        matrix = learning.feature_matrix(ws.mart, _columns_of(ws, name), STUMPS[name][0])
        return sampling.train_test_split(matrix, ws.settings, "label")

    return ws.staged(f"split_{name}", build)


def _forest(ws: Workspace, name: str) -> stumps.StumpForest:
    def build() -> stumps.StumpForest:
        train = _split_matrix(ws, name).filter("split = 'train'")
        return stumps.fit_forest(train, _columns_of(ws, name), STUMPS[name][1], ws.settings.seed, ws.settings.tree_bins)

    return ws.once(f"stumps_{name}", build)


def _tested(ws: Workspace, name: str) -> DataFrame:
    """The scored test split of a forest of stumps."""

    def build() -> DataFrame:
        tested = _forest(ws, name).score(_split_matrix(ws, name).filter("split = 'test'"))
        return tested.select("person_id", "label", "probability", "prediction", "split")

    return ws.staged(f"scored_{name}", build)


def _fitted(ws: Workspace, name: str) -> tuple[PipelineModel, DataFrame]:
    """A model of the comparison with its staged scored test split."""

    def build() -> tuple[PipelineModel, DataFrame]:
        columns = learning.full_columns(ws.mart)
        model, tested = learning.fit_and_score(ws.mart, columns, "is_successful", _compared(ws)[name], ws.settings)
        return model, ws.staged(f"scored_{name.lower().replace(' ', '_')}", lambda: tested)

    return ws.once(f"model_{name}", build)


def _scored(name: str) -> Query:
    return on_workspace(lambda ws: _tested(ws, name))


def _three_forests(ws: Workspace) -> DataFrame:
    return learning.union_scored((name, _tested(ws, name)) for name in STUMPS)


def _side_by_side(ws: Workspace, names: Iterable[str]) -> DataFrame:
    return learning.compare_models(learning.union_scored((n, _fitted(ws, n)[1]) for n in names))


def _best_report(ws: Workspace) -> DataFrame:
    names = _compared(ws)
    best = evaluation.best_model(_side_by_side(ws, names)).first()["model"]
    return evaluation.classification_report(_fitted(ws, best)[1]).withColumn("model", F.lit(best))


def _cv(ws: Workspace) -> DataFrame:
    """AUC per fold of a forest trained on the other folds."""

    def build() -> DataFrame:
        columns, settings = _full_columns(ws), ws.settings
        matrix = learning.feature_matrix(ws.mart, columns, "is_successful")
        folded = ws.staged("folds", lambda: sampling.cross_validation_folds(matrix, "label", settings.folds))
        forests = stumps.fit_folds(folded, columns, settings.folds, learning.FOREST_TREES, settings.seed, settings.tree_bins)
        scored = stumps.score_folds(folded, forests).select("fold", "label", "probability")
        return evaluation.roc_auc(ws.staged("fold_scores", lambda: scored), ["fold"]).orderBy("fold")

    return ws.once("cv", build)


def _importance(ws: Workspace) -> DataFrame:
    return learning.feature_importance(_fitted(ws, learning.FOREST)[0], learning.full_columns(ws.mart))


def _attribution(ws: Workspace) -> DataFrame:
    """What each feature adds to a person's vote share, over the whole test split."""

    def build() -> DataFrame:
        forest = _forest(ws, "full")
        tested = _split_matrix(ws, "full").filter("split = 'test'")
        return trees.attribution(tested, forest.columns, forest.nodes(ws.spark))[0]

    return ws.staged("attribution", build)


def _permutation(ws: Workspace) -> DataFrame:
    columns = learning.full_columns(ws.mart)
    matrix = learning.feature_matrix(ws.mart, columns, "is_successful")
    split = sampling.train_test_split(matrix, ws.settings, "label")
    tested = ws.staged("tested", lambda: split.filter("split = 'test'"))

    def build() -> DataFrame:
        model = _fitted(ws, learning.FOREST)[0]
        return learning.permutation_importance(
            model, tested, columns, ws.settings, lambda name, frame: ws.staged(name, lambda: frame)
        )

    return ws.once("permutation", build)


def _risks(ws: Workspace) -> DataFrame:
    """Every person scored with the early forest."""

    def build() -> DataFrame:
        matrix = learning.feature_matrix(ws.mart, features.EARLY_COLUMNS, "is_successful")
        return learning.with_risk(_forest(ws, "early").score(matrix), ws.settings)

    return ws.staged("risks", build)


def _business_case(ws: Workspace) -> DataFrame:
    return learning.business_case(
        _risks(ws), rates.success_by_milestones(ws.mart), rates.upgrade_candidates(ws.mart), ws.settings
    )


MODELS: dict[str, Query] = {
    "kmeans_segments": on_workspace(lambda ws: _segmented(ws).select("person_id", "cluster", "segment")),
    "kmeans_elbow": on_workspace(lambda ws: segments.elbow(ws.spark, _clusters(ws))),
    "pca_projection": on_workspace(
        lambda ws: _rounded(_segmented(ws).select("person_id", "segment", "pca_x", "pca_y"), "pca_x", "pca_y")
    ),
    "segment_success": on_workspace(
        lambda ws: _rounded(segments.segment_success(_segmented(ws)), "avg_events", "avg_tenure")
    ),
    "segment_sizes": on_workspace(lambda ws: segments.segment_sizes(_segmented(ws))),
    "segment_profile": on_workspace(lambda ws: segments.segment_profile(_segmented(ws))),
    "cluster_profile": on_workspace(lambda ws: segments.segment_profile(_segmented(ws), "cluster")),
    "segment_radar": on_workspace(
        lambda ws: _rounded(segments.segment_radar(_segmented(ws)), *segments.RADAR_COLUMNS)
    ),
    "segment_upgrade": on_workspace(lambda ws: segments.segment_upgrade(_segmented(ws))),
    "rf_full": _scored("full"),
    "rf_day3": _scored("early"),
    "rf_upgrade": _scored("upgrade"),
    "model_evaluation": on_workspace(lambda ws: learning.compare_models(_three_forests(ws))),
    "model_roc_curves": on_workspace(
        lambda ws: _rounded(evaluation.roc_points(_three_forests(ws), ["model"]), "threshold", "fpr", "tpr")
    ),
    "day3_threshold_sweep": on_workspace(lambda ws: evaluation.threshold_sweep(_tested(ws, "early"))),
    "cv_auc": on_workspace(lambda ws: _rounded(_cv(ws), "auc")),
    "cv_auc_interval": on_workspace(lambda ws: learning.auc_interval(_cv(ws))),
    "risk_scores": on_workspace(_risks),
    "risk_distribution": on_workspace(lambda ws: learning.risk_distribution(_risks(ws))),
    "business_case": on_workspace(_business_case),
    "model_comparison": on_workspace(_comparison),
    "newton_coefficients": on_workspace(lambda ws: _rounded(_newton(ws), "coefficient")),
    "boosted_stumps_early": on_workspace(lambda ws: _rounded(_boosted(ws, "early", 3), "probability")),
    "boosted_stumps": on_workspace(lambda ws: _rounded(_boosted(ws, "full", 3), "probability")),
    "boosted_stumps_150": on_workspace(
        lambda ws: _rounded(_boosted(ws, "full", learning.BOOSTING_ROUNDS), "probability")
    ),
    "vote_permutation": on_workspace(_vote_permutation),
    "best_model_report": on_workspace(_best_report),
    "feature_importance": on_workspace(lambda ws: _rounded(_forest(ws, "full").importance(ws.spark), "importance")),
    "deep_forest_importance": on_workspace(_importance),
    "vote_attribution": on_workspace(lambda ws: _rounded(_attribution(ws), "contribution")),
    "permutation_importance": on_workspace(_permutation),
}

QUERIES: dict[str, Query] = {**RELATIONAL, **MODELS}
