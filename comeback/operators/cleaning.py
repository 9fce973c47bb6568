"""Raw event log to clean events."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from comeback.config import Settings, Taxonomy
from comeback.functions.scalars import blank_trim, is_any

# Fixed value: what a missing operating system is called.
UNKNOWN_OS = "Unknown"
# Week numbers of the "continuous" mode count from this Monday.
WEEK_ORIGIN = "1970-01-05"


def parsed_time(raw: DataFrame, name: str = "timestamp") -> Column:
    """The column as a timestamp; text that is no time becomes null."""
    if isinstance(raw.schema[name].dataType, T.StringType):
        return F.try_to_timestamp(F.col(name))
    return F.col(name).cast("timestamp")


def week_key(day: Column, mode: str) -> Column:
    if mode == "iso":
        return F.weekofyear(day).cast("int")
    monday = F.date_trunc("week", day).cast("date")
    return (F.date_diff(monday, F.lit(WEEK_ORIGIN).cast("date")) / 7).cast("int")


def iso_week(key: Column, mode: str) -> Column:
    """ISO week number for display, from a week key."""
    if mode == "iso":
        return key.cast("int")
    return F.weekofyear(F.date_add(F.lit(WEEK_ORIGIN).cast("date"), key * 7)).cast("int")


def parse_times(raw: DataFrame) -> DataFrame:
    """Parse ``timestamp``; rows without a usable time are left out (counted by the profile)."""
    return raw.withColumn("timestamp", parsed_time(raw)).filter(F.col("timestamp").isNotNull())


def drop_repeated_events(events: DataFrame) -> DataFrame:
    """One row per event id, the earliest copy; rows without id count as copies of each other.

    A minimum over the whole row combines on the map side, so an id with any number of
    copies reaches its reducer as one row per map task.
    """
    others = [name for name in events.columns if name != "uuid"]
    ordered = ["timestamp", *[name for name in others if name != "timestamp"]]
    kept = events.groupBy("uuid").agg(F.min(F.struct(*[F.col(f"`{n}`") for n in ordered])).alias("kept"))
    return kept.select(*["uuid" if n == "uuid" else F.col(f"kept.`{n}`") for n in events.columns])


def dedupe_report(raw: DataFrame) -> DataFrame:
    """Rows before and after removing repeated ids, and how many were removed."""
    per_id = raw.groupBy("uuid").agg(F.count(F.lit(1)).alias("copies"))
    return per_id.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
    ).withColumn("removed", F.col("rows_before") - F.col("rows_after"))


def add_calendar(events: DataFrame, settings: Settings) -> DataFrame:
    at = F.col("timestamp")
    return events.withColumns(
        {
            "date": F.to_date(at),
            "hour": F.hour(at),
            "dow": F.date_format(at, "EEEE"),
            "week": F.weekofyear(at),
            "month": F.month(at),
            "week_key": week_key(F.to_date(at), settings.week_mode),
        }
    )


def add_flags(events: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """0/1 columns for the five categories and for signup."""
    name = F.col("event")
    flags = {f"is_{kind}_event": is_any(name, names) for kind, names in taxonomy.categories().items()}
    flags["is_signup"] = is_any(name, taxonomy.signup)
    return events.withColumns(flags)


def in_no_category(taxonomy: Taxonomy) -> Column:
    """Events that carry none of the five category flags."""
    return ~reduce(or_, [F.col(f"is_{kind}_event") == 1 for kind in taxonomy.categories()])


def keep_events(raw: DataFrame, settings: Settings) -> DataFrame:
    """Parse, deduplicate and trim: the contract columns of the events that count."""
    events = parse_times(raw)
    if settings.dedupe:
        events = drop_repeated_events(events)
    return events.withColumn("prop_$os", blank_trim(F.col("`prop_$os`"), UNKNOWN_OS))


def describe_events(kept: DataFrame, settings: Settings) -> DataFrame:
    """Add calendar columns and category flags."""
    return add_flags(add_calendar(kept, settings), settings.taxonomy)


def clean_events(raw: DataFrame, settings: Settings) -> DataFrame:
    return describe_events(keep_events(raw, settings), settings)
