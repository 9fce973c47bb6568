"""Cohort retention, survival and cumulative activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from comeback.config import Settings
from comeback.functions.scalars import percent, round_half_even, text_bar
from comeback.operators.cleaning import iso_week


def cohort_sizes(people: DataFrame, settings: Settings) -> DataFrame:
    """Users per week of first activity."""
    sizes = people.groupBy(F.col("first_week").alias("cohort")).agg(F.count(F.lit(1)).alias("cohort_size"))
    week = iso_week(F.col("cohort"), settings.week_mode).alias("signup_week")
    return sizes.select("cohort", week, "cohort_size").orderBy("cohort")


def cohort_retention(weeks: DataFrame, people: DataFrame, settings: Settings) -> DataFrame:
    """Distinct active users and their share per cohort and week offset."""
    offset = F.col("weeks_since_first")
    kept = weeks.filter(offset.between(0, settings.max_week_offset))
    users = F.count("person_id") if settings.week_mode == "continuous" else F.count_distinct("person_id")
    cohort = (F.col("week_key") - offset).alias("cohort")
    active = kept.groupBy(cohort, offset.alias("week_offset")).agg(users.alias("users"))
    # One row per week of history, so small for any number of users.
    sized = active.join(cohort_sizes(people, settings), "cohort")
    rate = percent(F.col("users"), F.col("cohort_size")).alias("retention_rate")
    return sized.select("cohort", "signup_week", "week_offset", "users", "cohort_size", rate).orderBy(
        "cohort", "week_offset"
    )


def cohort_matrix(retention: DataFrame, settings: Settings) -> DataFrame:
    """Cohorts as rows, week offsets as columns, absent cells 0; small cohorts left out."""
    offsets = list(range(settings.max_week_offset + 1))
    large = retention.filter(F.col("cohort_size") >= settings.min_cohort_users)
    grid = large.groupBy("cohort", "signup_week").pivot("week_offset", offsets).agg(F.avg("retention_rate"))
    cells = [F.coalesce(F.col(str(i)), F.lit(0.0)).alias(f"w{i}") for i in offsets]
    return grid.select("cohort", "signup_week", *cells).orderBy("cohort")


def average_retention_curve(retention: DataFrame, dense: bool = False) -> DataFrame:
    """Unweighted mean rate per offset over the cohorts active there.

    ``dense`` counts a cohort without activity at an offset as 0 instead.
    """
    curve = retention.groupBy("week_offset")
    if not dense:
        averaged = curve.agg(F.avg("retention_rate").alias("avg_rate"))
    else:
        cohorts = retention.agg(F.count_distinct("cohort").alias("cohorts"))
        sums = curve.agg(F.sum("retention_rate").alias("total")).crossJoin(F.broadcast(cohorts))
        averaged = sums.select("week_offset", (F.col("total") / F.col("cohorts")).alias("avg_rate"))
    return averaged.select("week_offset", round_half_even(F.col("avg_rate"), 6).alias("avg_rate")).orderBy(
        "week_offset"
    )


def retention_cliff(curve: DataFrame) -> DataFrame:
    """The offset with the largest drop from its predecessor; the earliest on ties."""
    # The curve has one row per week offset (13), so one task is the right size.
    change = F.col("avg_rate") - F.lag("avg_rate").over(Window.orderBy("week_offset"))
    drops = curve.withColumn("change", round_half_even(change, 6)).filter(F.col("change").isNotNull())
    return drops.orderBy("change", "week_offset").limit(1).select("week_offset", "avg_rate", "change")


def survival_curve(mart: DataFrame, settings: Settings) -> DataFrame:
    """Users with any activity at or after each week offset; always all offsets.

    A user counts at every offset up to the last one, so users are grouped by last offset and
    only those few groups meet the offsets.
    """
    last = settings.max_week_offset
    reach = F.least("weeks_reached", F.lit(last)).alias("reach")
    groups = mart.groupBy(reach).agg(F.count(F.lit(1)).alias("users"))
    weeks = F.explode(F.sequence(F.lit(0), F.lit(last)))
    per_week = groups.select(weeks.alias("week"), "reach", "users").groupBy("week").agg(
        F.sum(F.when(F.col("reach") >= F.col("week"), F.col("users")).otherwise(0)).alias("active"),
        F.sum("users").alias("total"),
    )
    pct = percent(F.col("active"), F.col("total"))
    return per_week.select("week", "active", pct.alias("pct"), text_bar(pct).alias("bar")).orderBy("week")


def daily_cumulative_events(activity: DataFrame, mart: DataFrame, settings: Settings) -> DataFrame:
    """Running event count by day since first event, for each label."""
    early = activity.filter(F.col("days_since_first") <= settings.curve_days)
    per_person = early.groupBy("person_id", "days_since_first").agg(F.sum("n").alias("n"))
    labelled = per_person.join(mart.select("person_id", "is_successful"), "person_id")
    daily = labelled.groupBy("is_successful", "days_since_first").agg(F.sum("n").alias("n"))
    # At most curve_days + 1 rows per label reach the window.
    so_far = Window.partitionBy("is_successful").orderBy("days_since_first")
    so_far = so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = daily.select("is_successful", "days_since_first", F.sum("n").over(so_far).alias("events"))
    return running.orderBy("is_successful", "days_since_first")
