"""Event-volume reports, all answered from the activity rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comeback.config import Settings, Taxonomy
from comeback.functions.scalars import is_any

# Report labels and their order.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
CATEGORY_LABELS = {
    "agent": "Agent Events",
    "production": "Production Events",
    "canvas": "Canvas Events",
    "collab": "Collab Events",
    "credit": "Credit Events",
}
OTHER_CATEGORY = "Other"


def rows_from(totals: DataFrame, label: str, value: str, pairs: list[tuple[str, Column]]) -> DataFrame:
    """Turn one row of totals into one row per (label, value), numbered in the given order."""
    entries = [
        F.struct(F.lit(i).alias("position"), F.lit(name).alias(label), column.alias(value))
        for i, (name, column) in enumerate(pairs, start=1)
    ]
    return totals.select(F.inline(F.array(*entries)))


def category_breakdown(activity: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Events per category; an event may count in several, "Other" is none of them."""
    flags = {kind: is_any(F.col("event"), names) for kind, names in taxonomy.categories().items()}
    n = F.col("n")
    totals = activity.agg(
        *[F.sum(flag * n).alias(kind) for kind, flag in flags.items()],
        F.sum(F.when(F.greatest(*flags.values()) == 0, n).otherwise(0)).alias("other"),
    )
    pairs = [(label, F.col(kind)) for kind, label in CATEGORY_LABELS.items()]
    pairs.append((OTHER_CATEGORY, F.col("other")))
    return rows_from(totals, "category", "count", pairs)


def weekly_events(activity: DataFrame, names: tuple[str, ...] | None = None, alias: str = "events") -> DataFrame:
    """Events per week, of all names or of the given ones."""
    chosen = activity if names is None else activity.filter(F.col("event").isin(*names))
    return chosen.groupBy("week_key", "week").agg(F.sum("n").alias(alias)).orderBy("week_key")


def weekly_active_users(weeks: DataFrame, settings: Settings) -> DataFrame:
    """Distinct users per week; in continuous mode a person has one row per week."""
    users = F.count("person_id") if settings.week_mode == "continuous" else F.count_distinct("person_id")
    return weeks.groupBy("week_key", "week").agg(users.alias("users")).orderBy("week_key")


def hourly_events(activity: DataFrame) -> DataFrame:
    return activity.groupBy("hour").agg(F.sum("n").alias("events")).orderBy("hour")


def weekday_events(activity: DataFrame) -> DataFrame:
    """All seven weekdays from Monday on; a day without events has a null count."""
    days = activity.sparkSession.createDataFrame(list(enumerate(WEEKDAYS, 1)), "position int, dow string")
    counts = activity.groupBy(F.date_format("date", "EEEE").alias("dow")).agg(F.sum("n").alias("events"))
    return days.join(counts, "dow", "left").select("position", "dow", "events").orderBy("position")


def os_distribution(activity: DataFrame, limit: int = 6) -> DataFrame:
    counts = activity.groupBy("os").agg(F.sum("n").alias("count"))
    return counts.orderBy(F.desc("count"), "os").limit(limit)
