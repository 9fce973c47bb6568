"""Physical plans: what is read, what moves, what stays inside the JVM."""

from __future__ import annotations

import re

import pytest

from comeback.operators import activity as act
from comeback.operators import features, rates, scoring, segments, trends
from comeback.plans.catalog import RELATIONAL, workspace
from comeback.plans.testlog import TEST_SETTINGS

FOLDER = "/root/testdata/sf0.001"


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def ws(spark):
    return workspace(spark, FOLDER)


@pytest.mark.parametrize("name", sorted(RELATIONAL))
def test_no_python_in_any_plan(spark, name):
    plan = plan_of(RELATIONAL[name](spark, FOLDER))
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan


def test_report_reads_its_columns_only(ws):
    plan = plan_of(trends.hourly_events(ws.activity))
    assert "ReadSchema: struct<hour:int,n:bigint>" in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_small_people_do_not_move_events(ws):
    plan = plan_of(act.event_offsets(ws.events, ws.people, TEST_SETTINGS, people_rows=10))
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_mart_parts_meet_in_place(ws):
    names = features.most_frequent_events(ws.activity, 20)
    plan = plan_of(features.person_features(ws.activity, ws.weeks, TEST_SETTINGS, names))
    exchanges = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    keys = [re.sub(r"#\d+L?", "", keys) for keys in exchanges]
    # Names and platforms are combined per person first; the three parts then meet without another shuffle.
    assert sorted(keys) == ["person_id"] * 3 + ["person_id, event", "person_id, os"]


def test_mart_report_is_one_pass(ws):
    plan = plan_of(rates.milestone_lift(ws.mart))
    assert plan.count("FileScan") == 1
    assert "Join" not in plan


def test_score_and_label_are_projections(ws):
    people = features.add_derived(ws.features, TEST_SETTINGS)
    plan = plan_of(scoring.add_label(scoring.add_scores(people, TEST_SETTINGS), TEST_SETTINGS))
    assert "Exchange" not in plan and "Join" not in plan and "Aggregate" not in plan


def test_lloyd_step_moves_means_only(ws):
    scaled = segments.standardised(ws.mart)
    plan = plan_of(segments.lloyd_step(scaled, segments.seed_centres(scaled, 4)))
    assert re.findall(r"Exchange hashpartitioning\((\w+)#", plan) == ["cluster"]
    assert "partial_avg" in plan and "CartesianProduct" not in plan
