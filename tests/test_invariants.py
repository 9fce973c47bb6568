"""Properties that hold on any log, checked on the driver's data."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from comeback.operators import cohorts, funnel, rates
from comeback.plans.catalog import QUERIES, workspace

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ws(spark):
    return workspace(spark, FOLDER)


def test_scores_are_percentages(ws):
    for name in ("retention_score", "depth_score", "volume_score", "success_score"):
        low, high = ws.mart.agg(F.min(name), F.max(name)).first()
        assert 0 <= low <= high <= 100


def test_windows_are_nested(ws):
    mart = ws.mart
    for name in ("total_events", "agent_events", "production_events", "canvas_events"):
        wrong = mart.filter((F.col(f"d3_{name}") > F.col(f"fw_{name}")) | (F.col(f"fw_{name}") > F.col(name)))
        assert wrong.count() == 0


def test_buckets_cover_everybody(ws):
    users = ws.mart.count()
    for key in ("agent_speed", "ttv_bucket", "milestones_hit", "signup_period"):
        assert rates.rate_by(ws.mart, key).agg(F.sum("users")).first()[0] == users


def test_intervals_enclose_the_rate(ws):
    rows = rates.success_by_agent_speed(ws.mart)
    assert rows.filter("ci_lo > success_rate + 0.05 OR ci_hi < success_rate - 0.05").count() == 0


def test_survival_falls(ws):
    rows = cohorts.survival_curve(ws.mart, ws.settings).collect()
    shares = [row["pct"] for row in rows]
    assert len(rows) == 13 and shares[0] == 100.0
    assert shares == sorted(shares, reverse=True)


def test_retention_starts_at_one_hundred(ws):
    rows = cohorts.cohort_retention(ws.weeks, ws.people, ws.settings)
    assert {row[0] for row in rows.filter("week_offset = 0").select("retention_rate").collect()} == {100.0}


def test_funnel_stages_within_first(ws):
    stages = funnel.user_funnel(ws.mart, ws.settings)
    assert stages.filter("pct_of_first > 100").count() == 0


def test_split_sizes(spark):
    rows = QUERIES["stratified_split"](spark, FOLDER).groupBy("label", "split").count().collect()
    sizes = {(r["label"], r["split"]): r["count"] for r in rows}
    for label in (0, 1):
        total = sizes[label, "test"] + sizes[label, "train"]
        assert sizes[label, "test"] == max(1, int(total * 0.2))
