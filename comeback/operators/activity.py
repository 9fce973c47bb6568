"""Events placed relative to each person's first event, and their rollup.

A single person may own a large share of all events (bots, shared accounts), so nothing here
groups raw events by person in one task: the first event comes from a map-side combined
aggregate, and the join back is a broadcast or a join on (person, slice).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comeback.config import Settings
from comeback.functions.scalars import whole_days
from comeback.operators.cleaning import iso_week, week_key

# Events without a person never match; they only need spreading.
NO_PERSON_SLICES = 1 << 20


def first_activity(events: DataFrame) -> DataFrame:
    """Per person: first event time, first week, number of events."""
    known = events.filter(F.col("person_id").isNotNull())
    return known.groupBy("person_id").agg(
        F.min("timestamp").alias("first_seen"),
        F.min("week_key").alias("first_week"),
        F.count(F.lit(1)).alias("n_events"),
    )


def attach_first_activity(
    events: DataFrame, people: DataFrame, settings: Settings, people_rows: int | None = None
) -> DataFrame:
    """Join each event with its person's first activity; events without person stay.

    With a known row count up to ``broadcast_people_rows`` the people are broadcast and the
    events do not move. Otherwise both sides are shuffled by (person, slice): a person has one
    slice per ``rows_per_slice`` events, so the table of people with several slices, which is
    broadcast, has at most ``total events / rows_per_slice`` rows.
    """
    facts = people.select("person_id", "first_seen", "first_week")
    if people_rows is not None and people_rows <= settings.broadcast_people_rows:
        return events.join(F.broadcast(facts), "person_id", "left")

    slices = F.ceil(F.col("n_events") / settings.rows_per_slice).cast("int")
    busy = people.filter(F.col("n_events") > settings.rows_per_slice)
    busy = busy.select("person_id", slices.alias("_slices"))
    spread = F.when(F.col("person_id").isNull(), NO_PERSON_SLICES).otherwise(
        F.coalesce("_slices", F.lit(1))
    )
    position = F.pmod(F.xxhash64("uuid", "timestamp", "event"), spread).cast("int")
    sliced = events.join(F.broadcast(busy), "person_id", "left").withColumn("_slice", position)
    copies = people.withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    copies = copies.select("person_id", "_slice", "first_seen", "first_week")
    return sliced.join(copies, ["person_id", "_slice"], "left").drop("_slice", "_slices")


def event_offsets(
    events: DataFrame, people: DataFrame, settings: Settings, people_rows: int | None = None
) -> DataFrame:
    """Clean events plus ``days_since_first`` (full 24 h periods) and ``weeks_since_first``."""
    placed = attach_first_activity(events, people, settings, people_rows)
    return placed.withColumns(
        {
            "days_since_first": whole_days(F.col("first_seen"), F.col("timestamp")),
            "weeks_since_first": F.col("week_key") - F.col("first_week"),
        }
    )


def activity_rollup(offsets: DataFrame, settings: Settings) -> DataFrame:
    """Event counts by person, event name, platform, hour and day offset.

    All distinct counts, first occurrences, cohorts and trends are answered from this table.
    Per person it is bounded by names x platforms x active hours, however many events there are.
    """
    keys = ["person_id", "event", "os", "date", "hour", "days_since_first", "weeks_since_first"]
    rolled = (
        offsets.withColumnRenamed("prop_$os", "os")
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("uuid").alias("n_ids"),
            F.min("timestamp").alias("first_at"),
            F.max("timestamp").alias("last_at"),
        )
    )
    keyed = rolled.withColumn("week_key", week_key(F.col("date"), settings.week_mode))
    return keyed.withColumn("week", iso_week(F.col("week_key"), settings.week_mode))
