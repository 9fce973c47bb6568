"""Composite success score and its top-quantile label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comeback.config import Settings
from comeback.functions.scalars import round_half_even
from comeback.functions.statistics import min_max, row_mean
from comeback.operators.ordered import exact_quantile

RETENTION_PARTS = ("tenure_days", "active_days", "active_weeks", "events_per_day", "weekly_cadence")
DEPTH_PARTS = (
    "agent_ratio",
    "production_ratio",
    "collab_ratio",
    "event_diversity",
    "ever_published_app",
    "ever_scheduled",
    "ever_shared",
)
VOLUME_PARTS = ("total_events", "unique_event_types", "credit_events")


def add_scores(people: DataFrame, settings: Settings) -> DataFrame:
    """Sub-scores and weighted score from globally min-max scaled features.

    The extremes are a fixed number of scalars fetched by one small job, so scoring is a plain
    projection: the people are not moved.
    """
    sources = [c for c in (*RETENTION_PARTS, *DEPTH_PARTS, *VOLUME_PARTS) if c != "event_diversity"]
    row = people.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in sources for f in (F.min, F.max)]).first()
    extremes = {c: (row[f"min_{c}"], row[f"max_{c}"]) for c in sources}
    fewest, most = extremes["unique_event_types"]
    diversity = F.col("unique_event_types") / F.lit(most)
    if most:
        extremes["event_diversity"] = (fewest / most, 1.0)
    else:
        extremes["event_diversity"] = (None, None)

    def score(parts: tuple[str, ...]) -> Column:
        scaled = [min_max(F.col(name), F.lit(extremes[name][0]), F.lit(extremes[name][1])) for name in parts]
        return row_mean(scaled) * 100

    retention, depth, volume = settings.score_weights
    return (
        people.withColumn("event_diversity", diversity)
        .withColumns(
            {
                "retention_score": score(RETENTION_PARTS),
                "depth_score": score(DEPTH_PARTS),
                "volume_score": score(VOLUME_PARTS),
            }
        )
        .withColumn(
            "success_score",
            retention * F.col("retention_score") + depth * F.col("depth_score") + volume * F.col("volume_score"),
        )
    )


def add_label(scored: DataFrame, settings: Settings) -> DataFrame:
    """``is_successful``: score at or above the quantile, ties included."""
    threshold = F.lit(exact_quantile(scored, "success_score", settings.success_quantile)).cast("double")
    return scored.withColumns(
        {
            "success_threshold": threshold,
            "is_successful": (F.col("success_score") >= threshold).cast("int"),
        }
    )


def success_summary(mart: DataFrame) -> DataFrame:
    return mart.agg(
        F.count(F.lit(1)).alias("users"),
        F.sum(F.col("is_successful").cast("bigint")).alias("successful"),
        round_half_even(F.max("success_threshold"), 6).alias("threshold"),
    )
