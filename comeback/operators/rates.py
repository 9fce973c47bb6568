"""Success and upgrade rates by any attribute of the person mart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comeback.config import Settings
from comeback.functions.buckets import AGENT_SPEED_LABELS, UNKNOWN
from comeback.functions.scalars import percent, percent_text, round_half_even
from comeback.functions.statistics import wilson_interval
from comeback.operators.features import MILESTONES
from comeback.operators.sampling import stratified_sample
from comeback.operators.trends import rows_from

# Report labels and feature lists.
MILESTONE_LABELS = ("Ran Code", "Used Agent", "Published App", "Returned Week 2", "10+ Event Types")
SHARING_LABELS = ("Never Shared", "Shared Canvas")
LIFETIME_COMPARISON = (
    "total_events",
    "active_days",
    "tenure_days",
    "agent_events",
    "production_events",
    "collab_events",
    "ever_published_app",
    "ever_scheduled",
    "used_addon_credits",
)
FIRST_WEEK_COMPARISON = (
    "fw_total_events",
    "fw_agent_events",
    "fw_production_events",
    "fw_canvas_events",
    "fw_unique_events",
    "fw_active_days",
)


def flagged(column: str, value: int = 1) -> Column:
    return F.sum(F.when(F.col(column) == value, F.lit(1)).otherwise(0)).cast("bigint")


def rate_by(
    mart: DataFrame, key: str, users: str = "users", min_users: int = 0, by_rate: bool = False
) -> DataFrame:
    """Users, successful users and success rate per value of ``key``.

    Groups below ``min_users`` are left out of the report; ``by_rate`` sorts by rate, else by key.
    """
    groups = mart.groupBy(key).agg(
        F.count("person_id").alias(users), flagged("is_successful").alias("successful")
    )
    rated = groups.filter(F.col(users) >= min_users).withColumn(
        "success_rate", percent(F.col("successful"), F.col(users))
    )
    return rated.orderBy(F.desc("success_rate"), key) if by_rate else rated.orderBy(key)


def with_interval(rates: DataFrame, users: str = "users") -> DataFrame:
    """Add the Wilson interval of the success rate."""
    low, high = wilson_interval(F.col("successful"), F.col(users))
    return rates.withColumns({"ci_lo": low, "ci_hi": high})


def success_by_agent_speed(mart: DataFrame) -> DataFrame:
    return with_interval(rate_by(mart, "agent_speed", users="total_users"), "total_users")


def success_by_time_to_value(mart: DataFrame) -> DataFrame:
    return rate_by(mart, "ttv_bucket")


def success_by_milestones(mart: DataFrame) -> DataFrame:
    return rate_by(mart, "milestones_hit")


def success_by_first_event(mart: DataFrame, settings: Settings, limit: int = 12) -> DataFrame:
    known = mart.filter(F.col("first_event").isNotNull())
    return rate_by(known, "first_event", min_users=settings.min_group_users, by_rate=True).limit(limit)


def success_by_os(mart: DataFrame, settings: Settings) -> DataFrame:
    return rate_by(mart, "os_platform", min_users=settings.min_group_users, by_rate=True)


def success_by_signup_period(mart: DataFrame) -> DataFrame:
    return rate_by(mart.filter(F.col("signup_period") != UNKNOWN), "signup_period", by_rate=True)


def success_by_first_week_days(mart: DataFrame) -> DataFrame:
    """Share of successful users per number of active days in the first week."""
    days = mart.groupBy("fw_active_days")
    return days.agg(round_half_even(F.avg("is_successful"), 6).alias("success_rate")).orderBy("fw_active_days")


def sharing_effect(mart: DataFrame) -> DataFrame:
    """Success and upgrade rate of users who ever shared against those who did not."""
    groups = mart.groupBy("ever_shared").agg(
        F.count("person_id").alias("users"),
        flagged("is_successful").alias("successful"),
        flagged("is_upgrade_candidate").alias("upgrade_cands"),
    )
    users = F.col("users")
    return groups.select(
        F.when(F.col("ever_shared") == 1, SHARING_LABELS[1]).otherwise(SHARING_LABELS[0]).alias("label"),
        "users",
        "successful",
        "upgrade_cands",
        percent(F.col("successful"), users).alias("success_rate"),
        percent(F.col("upgrade_cands"), users).alias("upgrade_rate"),
    ).orderBy("label")


def publish_effect(mart: DataFrame) -> DataFrame:
    """Success rate with interval of app publishers and of everybody else."""
    return with_interval(rate_by(mart, "ever_published_app"))


def publish_contingency(mart: DataFrame) -> DataFrame:
    pairs = mart.groupBy("ever_published_app", "is_successful").agg(F.count(F.lit(1)).alias("users"))
    return pairs.orderBy("ever_published_app", "is_successful")


def milestone_lift(mart: DataFrame, outcome: str = "is_successful") -> DataFrame:
    """Outcome rate of users who hit each milestone and of those who missed it, in one pass."""

    def rate(milestone: str, hit: int) -> Column:
        return round_half_even(F.avg(F.when(F.col(milestone) == hit, F.col(outcome))) * 100, 1)

    totals = mart.agg(
        *[rate(m, 1).alias(f"{m}_hit") for m in MILESTONES],
        *[rate(m, 0).alias(f"{m}_miss") for m in MILESTONES],
    )
    pairs = [
        (label, F.struct(F.col(f"{m}_hit").alias("hit"), F.col(f"{m}_miss").alias("miss")))
        for m, label in zip(MILESTONES, MILESTONE_LABELS)
    ]
    long = rows_from(totals, "milestone", "rates", pairs)
    return long.select("position", "milestone", F.col("rates.hit").alias("hit_rate"), F.col("rates.miss").alias("miss_rate"))


def upgrade_candidates(mart: DataFrame) -> DataFrame:
    totals = mart.agg(F.count("person_id").alias("users"), flagged("is_upgrade_candidate").alias("candidates"))
    return totals.withColumn("pct", percent(F.col("candidates"), F.col("users")))


def one_time_visitors(mart: DataFrame, settings: Settings) -> DataFrame:
    """Users with at most ``one_time_events`` events, and their share."""
    few = (F.col("total_events") <= settings.one_time_events).cast("int")
    totals = mart.agg(F.count("person_id").alias("users"), F.sum(few).alias("one_time_users"))
    share = percent(F.col("one_time_users"), F.col("users"))
    return totals.withColumn("pct", share).withColumn("pct_text", percent_text(share, "% of users"))


def feature_means_by_label(mart: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean of each feature for unsuccessful and successful users, one row per feature."""

    def mean(name: str, label: int) -> Column:
        return round_half_even(F.avg(F.when(F.col("is_successful") == label, F.col(name))), 6)

    totals = mart.agg(*[mean(c, v).alias(f"{c}_{v}") for c in columns for v in (0, 1)])
    pairs = [(c, F.struct(F.col(f"{c}_0").alias("low"), F.col(f"{c}_1").alias("high"))) for c in columns]
    long = rows_from(totals, "feature", "means", pairs)
    return long.select(
        "position", "feature", F.col("means.low").alias("unsuccessful"), F.col("means.high").alias("successful")
    )


def score_histogram(mart: DataFrame, bins: int = 60, dense: bool = False) -> DataFrame:
    """Users per equal-width bin of the success score between its extremes.

    Empty bins are absent, or have no users if ``dense``.
    """
    extremes = mart.agg(F.min("success_score").alias("low"), F.max("success_score").alias("high"))
    spread = F.col("high") - F.col("low")
    place = F.floor((F.col("success_score") - F.col("low")) / F.when(spread == 0, 1.0).otherwise(spread) * bins)
    placed = mart.crossJoin(F.broadcast(extremes)).withColumn("bin", F.least(place, F.lit(bins - 1)).cast("int"))
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("users"))
    if dense:
        every = mart.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
        counts = every.join(F.broadcast(counts), "bin", "left").fillna(0, ["users"])
    return counts.orderBy("bin")


def volume_points(mart: DataFrame, limit: int = 800) -> DataFrame:
    """Logarithm of the number of events of at most ``limit`` persons of each label."""
    sample = stratified_sample(mart.select("person_id", "is_successful", "total_events"), "is_successful", limit)
    return sample.select("person_id", "is_successful", round_half_even(F.log1p("total_events"), 6).alias("log_events"))


def retention_depth_points(mart: DataFrame, limit: int = 1500) -> DataFrame:
    """Both scores of at most ``limit`` persons of each label, with their events clipped to [1, 500]."""
    columns = ("person_id", "is_successful", "retention_score", "depth_score", "total_events")
    sample = stratified_sample(mart.select(*columns), "is_successful", limit)
    clipped = F.greatest(F.lit(1), F.least("total_events", F.lit(500))).cast("bigint")
    scores = [round_half_even(F.col(c), 6).alias(c) for c in ("retention_score", "depth_score")]
    return sample.select("person_id", "is_successful", *scores, clipped.alias("size"))


def agent_histogram(mart: DataFrame, limit: int = 200, bins: int = 50) -> DataFrame:
    """Agent events clipped to [0, limit] in equal-width bins, by label."""
    clipped = F.greatest(F.lit(0), F.least("agent_events", F.lit(limit)))
    place = F.least(F.floor(clipped * bins / limit), F.lit(bins - 1)).cast("int")
    counts = mart.groupBy("is_successful", place.alias("bin")).agg(F.count(F.lit(1)).alias("users"))
    return counts.orderBy("is_successful", "bin")


def volume_correlation(mart: DataFrame) -> DataFrame:
    """Correlation of raw volume and of first-week days with success, and how much stronger."""

    def correlation(name: str) -> Column:
        varies = (F.stddev_pop(name) > 0) & (F.stddev_pop("is_successful") > 0)
        return F.when(varies, F.corr(F.col(name).cast("double"), F.col("is_successful").cast("double")))

    pair = mart.agg(
        correlation("total_events").alias("volume"), correlation("fw_active_days").alias("first_week")
    )
    strength = F.col("first_week") / F.greatest(F.abs("volume"), F.lit(0.001))
    return pair.select(
        round_half_even(F.col("volume"), 6).alias("corr_volume"),
        round_half_even(F.col("first_week"), 6).alias("corr_first_week"),
        round_half_even(strength, 4).alias("times_stronger"),
    )


def cell(report: DataFrame, key: str, value: object, column: str) -> Column:
    """One cell of a report as a scalar subquery; null when the row is absent."""
    return report.filter(F.col(key) == F.lit(value)).agg(F.first(column)).scalar()


def headline_numbers(mart: DataFrame, settings: Settings) -> DataFrame:
    """The closing summary in one row: publishing, early use, patience and one-time visitors."""
    speed = success_by_agent_speed(mart)
    publish = publish_effect(mart)
    within, _, later, _ = AGENT_SPEED_LABELS
    return one_time_visitors(mart, settings).select(
        "users",
        F.col("pct").alias("one_time_pct"),
        cell(publish, "ever_published_app", 1, "success_rate").alias("publisher_rate"),
        cell(publish, "ever_published_app", 0, "success_rate").alias("other_rate"),
        cell(speed, "agent_speed", within, "success_rate").alias("fast_rate"),
        cell(speed, "agent_speed", later, "success_rate").alias("patient_rate"),
        F.coalesce(cell(speed, "agent_speed", later, "ci_lo"), F.lit(0.0)).alias("patient_lo"),
        F.coalesce(cell(speed, "agent_speed", later, "ci_hi"), F.lit(0.0)).alias("patient_hi"),
    )
