"""One person with a third of all events, events without person, one repeated id."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from comeback import Settings, Workspace
from comeback.operators import activity as act
from comeback.operators.cleaning import clean_events

SLICED = Settings(rows_per_slice=500, broadcast_people_rows=0)


@pytest.fixture(scope="module")
def raw(spark):
    """12,000 events; the bot has 4,000, a thousand have no person, one id appears 2,000 times."""
    i = F.col("id")
    person = (
        F.when(i < 4000, "bot").when(i < 5000, F.lit(None)).otherwise(F.concat(F.lit("p"), (i % 211).cast("string")))
    )
    names = F.array(*[F.lit(n) for n in ("sign_up", "run_block", "agent_open", "canvas_open", "app_publish")])
    at = F.timestamp_seconds(F.lit(1_760_000_000) + (i * 7919) % 3_000_000)
    log = spark.range(12000).select(
        person.alias("person_id"),
        i.cast("string").alias("uuid"),
        F.element_at(names, ((i * 31) % 5 + 1).cast("int")).alias("event"),
        at.alias("timestamp"),
        F.when(i % 3 == 0, "Linux").alias("prop_$os"),
    )
    copies = log.filter("uuid = '77'").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(2000)))).drop("copy")
    return log.unionByName(copies)


def test_slices_and_broadcast_agree(spark, raw):
    events = clean_events(raw, SLICED)
    people = act.first_activity(events)
    columns = ["uuid", "person_id", "days_since_first", "weeks_since_first"]
    sliced = act.event_offsets(events, people, SLICED).select(columns)
    whole = act.event_offsets(events, people, Settings(), people_rows=people.count()).select(columns)
    assert sliced.count() == 12000
    assert sliced.exceptAll(whole).count() == 0
    plan = sliced._jdf.queryExecution().executedPlan().toString()
    assert "_slice" in plan


def test_no_slice_is_larger_than_asked(raw):
    events = clean_events(raw, SLICED)
    people = act.first_activity(events)
    placed = act.attach_first_activity(events, people, SLICED)
    assert placed.filter("person_id = 'bot' AND first_seen IS NULL").count() == 0
    parts = F.ceil(F.col("n_events") / SLICED.rows_per_slice)
    assert people.filter("person_id = 'bot'").select(parts).first()[0] == 8


def test_mart_is_the_same_either_way(spark, raw):
    one = Workspace(spark, raw, SLICED)
    # Force the sliced join by not telling the number of people.
    one.staged("activity", lambda: act.activity_rollup(act.event_offsets(one.events, one.people, SLICED), SLICED))
    two = Workspace(spark, raw, Settings())
    assert one.mart.exceptAll(two.mart).count() == 0
    assert one.mart.count() == two.mart.count() == 212


def test_counts_against_plain_sql(spark, raw):
    ws = Workspace(spark, raw, Settings())
    ws.events.createOrReplaceTempView("skewed_events")
    want = spark.sql(
        """SELECT person_id, count(uuid) AS total_events, count(DISTINCT event) AS unique_event_types,
                  count(DISTINCT date) AS active_days, count(DISTINCT week_key) AS active_weeks
           FROM skewed_events WHERE person_id IS NOT NULL GROUP BY person_id"""
    )
    got = ws.mart.select(want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
