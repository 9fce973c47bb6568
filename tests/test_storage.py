"""Reports, staged tables and models on disk."""

from __future__ import annotations

from dataclasses import replace
from types import SimpleNamespace

import pytest

from pyspark.sql import functions as F

from comeback import Workspace
from comeback.config import Taxonomy
from comeback.operators import learning, rates
from comeback.plans.testlog import TEST_SETTINGS, event_log
from comeback.sources.events import EVENT_SCHEMA, read_events
from comeback.sources.storage import load_model, save_model, shared_folder, write_report
from tests import sample

FOLDER = "/root/testdata/sf0.001"


def test_report_round_trip(spark, tmp_path):
    mart = Workspace(spark, sample.log(spark), sample.SETTINGS).mart
    report = rates.success_by_agent_speed(mart)
    path = write_report(report, str(tmp_path), "speed")
    stored = spark.read.parquet(path)
    assert [tuple(r) for r in stored.collect()] == [tuple(r) for r in report.collect()]


def test_reading_a_wide_log_prunes_columns(spark, tmp_path):
    path = str(tmp_path / "log")
    wide = sample.log(spark).selectExpr("*", "1 AS created_at", "2 AS other")
    wide.write.parquet(path)
    assert read_events(spark, path).columns == EVENT_SCHEMA.names
    assert read_events(spark, path, EVENT_SCHEMA).count() == len(sample.rows())
    plan = read_events(spark, path).select("event")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event:string>" in plan
    wide.drop("event").write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="event"):
        read_events(spark, str(tmp_path / "bad"))


def test_reopened_workspace_continues(spark, tmp_path):
    folder = str(tmp_path / "stage")
    first = Workspace(spark, event_log(spark, FOLDER), TEST_SETTINGS, folder)
    want = first.mart.exceptAll(Workspace.reopen(spark, folder, TEST_SETTINGS).mart)
    assert want.count() == 0


def test_reopening_with_other_settings_is_refused(spark, tmp_path):
    folder = str(tmp_path / "stage")
    first = Workspace(spark, event_log(spark, FOLDER), TEST_SETTINGS, folder)
    assert first.mart.count()
    with pytest.raises(ValueError, match="success_quantile"):
        Workspace.reopen(spark, folder, replace(TEST_SETTINGS, success_quantile=0.5))
    with pytest.raises(ValueError, match="taxonomy"):
        Workspace.reopen(spark, folder, replace(TEST_SETTINGS, taxonomy=Taxonomy()))
    assert Workspace.reopen(spark, folder).settings == TEST_SETTINGS


def test_time_zone_of_the_session_makes_no_difference(spark, tmp_path):
    log = event_log(spark, FOLDER)
    stamped = log.withColumn("timestamp", F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")))
    stamped.write.parquet(str(tmp_path / "log"))
    want = Workspace(spark, read_events(spark, str(tmp_path / "log")), TEST_SETTINGS).mart.collect()
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    got = Workspace(other, read_events(other, str(tmp_path / "log")), TEST_SETTINGS).mart.collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_closed_workspace_leaves_no_tables(spark):
    ws = Workspace(spark, sample.log(spark), sample.SETTINGS)
    assert ws.people.count()
    path = ws.folder
    ws.close()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(f"{path}/people")


def session_like(master: str, settings: dict[str, str]):
    """As much of a session as ``shared_folder`` looks at."""
    context = SimpleNamespace(master=master, getConf=lambda: settings, getCheckpointDir=lambda: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=context)


def test_shared_folder_is_the_configured_one():
    assert shared_folder(session_like("yarn", {"spark.checkpoint.dir": "hdfs:///stage"})) == "hdfs:///stage"


def test_cluster_without_shared_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session_like("yarn", {}))


def test_local_session_gets_a_folder(spark):
    assert shared_folder(spark) and shared_folder(spark) == shared_folder(spark)


def test_model_round_trip(spark, tmp_path):
    ws = Workspace(spark, event_log(spark, FOLDER), TEST_SETTINGS)
    columns = list(learning.EARLY_COLUMNS)
    model, tested = learning.fit_and_score(ws.mart, columns, "is_successful", learning.stump_forest(20, 1), TEST_SETTINGS)
    matrix = learning.feature_matrix(ws.mart, columns, "is_successful")
    save_model(model, str(tmp_path), "early")
    again = learning.score(load_model(str(tmp_path), "early"), matrix)
    here = learning.score(model, matrix)
    assert here.exceptAll(again).count() == 0
    assert tested.filter("probability < 0 OR probability > 1").count() == 0
