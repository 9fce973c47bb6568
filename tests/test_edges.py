"""Expectations worked out by hand on the sample log."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from comeback import Settings, Workspace
from comeback.operators import cleaning, cohorts, funnel, rates, trends
from comeback.operators import features as feat
from comeback.sources.events import dataset_profile, head_rows
from tests import sample


@pytest.fixture(scope="module")
def ws(spark):
    return Workspace(spark, sample.log(spark), sample.SETTINGS)


@pytest.fixture(scope="module")
def mart(ws):
    return {row["person_id"]: row for row in ws.mart.collect()}


def test_profile_counts_every_row(spark):
    row = dataset_profile(sample.log(spark)).first()
    assert (row["n_rows"], row["n_columns"], row["n_users"]) == (24, 5, 5)
    assert row["bad_timestamps"] == 1
    assert row["first_timestamp"] == sample.START
    near = dataset_profile(sample.log(spark), approximate=True).first()
    assert near["n_users"] == 5


def test_head(spark):
    assert head_rows(sample.log(spark)).count() == 5


def test_repeated_and_missing_ids_collapse(spark, ws):
    row = cleaning.dedupe_report(sample.log(spark)).first()
    assert (row["rows_before"], row["rows_after"], row["removed"]) == (24, 22, 2)
    kept = ws.events.filter("uuid IS NULL").collect()
    assert [(row["person_id"], row["event"]) for row in kept] == [("ann", "canvas_delete")]
    assert ws.events.count() == 21


def test_dedupe_can_be_switched_off(spark):
    events = cleaning.clean_events(sample.log(spark), Settings(dedupe=False))
    assert events.count() == 23


def test_platform_text(ws):
    names = {row[0] for row in ws.events.select("`prop_$os`").distinct().collect()}
    assert names == {"Linux", "Unknown", "Mac OS X", "Windows"}


def test_calendar(ws):
    row = ws.events.filter("person_id = 'ann' AND event = 'sign_up'").first()
    assert (row["date"], row["hour"], row["dow"], row["month"]) == (date(2025, 10, 6), 9, "Monday", 10)
    assert row["week"] == date(2025, 10, 6).isocalendar().week
    assert (row["is_signup"], row["is_agent_event"]) == (1, 0)


def test_nameless_event_has_no_flag(ws):
    row = ws.events.filter("event IS NULL").first()
    assert [row[f"is_{kind}_event"] for kind in sample.SETTINGS.taxonomy.categories()] == [0] * 5


def test_person_of_no_name_is_in_trends_only(ws, mart):
    assert set(mart) == {"ann", "bob", "cid", "dot", "eve"}
    assert sum(row["events"] for row in trends.hourly_events(ws.activity).collect()) == 21


def test_agent_speed_limits_are_inclusive(mart):
    assert {p: mart[p]["agent_speed"] for p in mart} == {
        "ann": "1_Within 2 Hours",
        "bob": "2_Within 24 Hours",
        "cid": "2_Within 24 Hours",
        "dot": "4_Never Used Agent",
        "eve": "3_After 24 Hours",
    }


def test_time_to_value_limits_are_inclusive(mart):
    assert {p: mart[p]["ttv_bucket"] for p in mart} == {
        "ann": "1_Under 1h",
        "bob": "2_Under 24h",
        "cid": "3_Under 72h",
        "dot": "5_Never",
        "eve": "1_Under 1h",
    }
    assert mart["bob"]["hours_to_first_agent"] == pytest.approx(2 + 1 / 3.6e9)


def test_first_week_ends_before_day_eight(mart):
    ann = mart["ann"]
    assert (ann["total_events"], ann["fw_total_events"], ann["d3_total_events"]) == (6, 5, 3)
    # The event without id has no part in the totals, but in the names.
    assert (ann["unique_event_types"], ann["fw_unique_events"], ann["d3_unique_events"]) == (5, 5, 4)
    assert (ann["active_days"], ann["fw_active_days"], ann["d3_active_days"]) == (3, 3, 1)
    assert (ann["tenure_days"], ann["active_weeks"]) == (8, 2)


def test_ties(mart):
    assert mart["cid"]["os_platform"] == "Linux"
    assert mart["eve"]["first_event"] == "block_create"
    assert mart["ann"]["os_platform"] == "Linux"


def test_signup_hour(mart):
    assert (mart["ann"]["signup_hour"], mart["ann"]["signup_period"]) == (9, "🌅 Morning (6-12)")
    assert (mart["bob"]["signup_hour"], mart["bob"]["signup_period"]) == (None, "Unknown")


def test_flags(mart):
    assert mart["bob"]["ever_published_app"] == 1
    assert mart["cid"]["ever_shared"] == 1
    assert mart["dot"]["collab_events"] == 1
    assert [mart[p]["milestones_hit"] for p in sorted(mart)] == [3, 3, 2, 0, 2]


def test_constant_column_scales_to_zero(spark):
    one = Workspace(spark, sample.log(spark).filter("person_id = 'dot'"), sample.SETTINGS).mart.first()
    assert one["success_score"] == 0.0
    assert one["is_successful"] == 1  # the only score is its own quantile


def test_score_ties_at_the_threshold_all_succeed(spark):
    rows = [(f"p{i}", f"u{i}", "run_block", "2025-10-06 10:00:00", None) for i in range(4)]
    raw = spark.createDataFrame(rows, sample.log(spark).schema)
    assert Workspace(spark, raw, sample.SETTINGS).mart.agg(F.sum("is_successful")).first()[0] == 4


def test_new_year(spark):
    at = [datetime(2024, 12, 25, 12), datetime(2025, 1, 2, 12), datetime(2025, 12, 24, 12)]
    rows = [("p", f"u{i}", "run_block", str(t), None) for i, t in enumerate(at)]
    raw = spark.createDataFrame(rows, sample.log(spark).schema)
    running = Workspace(spark, raw, sample.SETTINGS)
    assert running.mart.first()["active_weeks"] == 3
    assert [r["week_offset"] for r in cohorts.cohort_retention(running.weeks, running.people, running.settings).collect()] == [0, 1]
    assert cohorts.cohort_sizes(running.people, running.settings).first()["signup_week"] == 52
    iso = Workspace(spark, raw, Settings(week_mode="iso"))
    assert iso.mart.first()["active_weeks"] == 2  # weeks 52 and 1, the former in two years
    assert iso.people.first()["first_week"] == 1
    users = trends.weekly_active_users(iso.weeks, iso.settings).collect()
    assert [(r["week"], r["users"]) for r in users] == [(1, 1), (52, 1)]


@pytest.mark.parametrize("top_events", [1, 3, 20])
def test_funnel_does_not_depend_on_the_matrix(spark, ws, top_events):
    narrow = Workspace(spark, sample.log(spark), replace(sample.SETTINGS, top_events=top_events))
    want = funnel.user_funnel(ws.mart, ws.settings).collect()
    assert funnel.user_funnel(narrow.mart, narrow.settings).collect() == want
    narrow.close()


def test_absent_report_row_is_null(ws):
    report = rates.success_by_agent_speed(ws.mart)
    cell = rates.cell(report, "agent_speed", "no such bucket", "success_rate")
    assert report.select(cell.alias("c")).first()["c"] is None


def test_empty_bucket_is_absent_and_labels_stay(ws):
    report = rates.success_by_time_to_value(ws.mart).collect()
    assert [r["ttv_bucket"] for r in report] == ["1_Under 1h", "2_Under 24h", "3_Under 72h", "5_Never"]
    assert [r["users"] for r in report] == [2, 1, 1, 1]
