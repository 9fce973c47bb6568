"""A hand-made log with every edge on it; expectations are written out in the tests."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from comeback.config import Settings
from comeback.sources.events import EVENT_SCHEMA

START = datetime(2025, 10, 6, 9, 30)  # a Monday
SETTINGS = Settings(min_group_users=1, min_cohort_users=1)
HOUR, DAY = timedelta(hours=1), timedelta(days=1)
MICRO = timedelta(microseconds=1)


def rows() -> list[tuple]:
    entries: list[tuple] = []

    def add(person: str | None, event: str | None, after: timedelta | str, os: str | None = "Linux", uid: str | None = ""):
        at = after if isinstance(after, str) else (START + after).isoformat(sep=" ")
        entries.append((person, f"u{len(entries)}" if uid == "" else uid, event, at, os))

    # ann: agent after exactly 2 h, production after exactly 1 h, events at 7 x 24 h and 8 x 24 h.
    add("ann", "sign_up", timedelta(0))
    add("ann", "run_block", HOUR, None)
    add("ann", "agent_open", 2 * HOUR, "  Mac OS X ")
    add("ann", "agent_open", 7 * DAY, "Mac OS X")
    add("ann", "canvas_open", 8 * DAY - MICRO)
    add("ann", "canvas_open", 8 * DAY)
    # bob: agent after 2 h and a microsecond, production after exactly 24 h.
    add("bob", "canvas_open", timedelta(0))
    add("bob", "agent_message", 2 * HOUR + MICRO)
    add("bob", "app_publish", DAY)
    # cid: agent after exactly 24 h, production after exactly 72 h; two systems equally often.
    add("cid", "canvas_open", timedelta(0), "Windows")
    add("cid", "agent_message", DAY, "Linux")
    add("cid", "run_block", 3 * DAY, "Windows")
    add("cid", "canvas_share", 3 * DAY, "Linux")
    # dot: a single event; eve: two events at the same instant, agent only after 24 h.
    add("dot", "link_clicked", 30 * HOUR, None)
    add("eve", "run_block", timedelta(0))
    add("eve", "block_create", timedelta(0))
    add("eve", "agent_open", DAY + MICRO)
    add("eve", "run_block", 72 * HOUR + MICRO)
    # A repeated id, an unreadable time, an event without person, one without name, a pair without id.
    add("dot", "link_clicked", 30 * HOUR, None, uid=entries[13][1])
    add("bob", "canvas_open", "yesterday")
    add(None, "canvas_open", 5 * HOUR)
    add("bob", None, 3 * HOUR)
    add("ann", "canvas_delete", 4 * HOUR, uid=None)
    add("bob", "canvas_delete", 5 * HOUR, uid=None)
    return entries


def log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), EVENT_SCHEMA)
