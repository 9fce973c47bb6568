"""The staged tables every report reads."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict
from typing import Any, TypeVar

from pyspark.sql import DataFrame, SparkSession

from comeback.config import Settings, Taxonomy
from comeback.operators import activity as act
from comeback.operators import features, scoring
from comeback.operators.cleaning import describe_events, keep_events
from comeback.sources.storage import remove_folder, shared_folder, use_utc, write_table

T = TypeVar("T")
TABLES = ("events", "people", "activity", "weeks", "features", "mart")
# HotSpot interprets methods beyond this size; below it, Spark uses its split projections instead.
JIT_METHOD_BYTES = "8000"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for the duration of a block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Workspace:
    """Builds each table on first use, writes it to the shared folder and reads it back.

    Order of tables: ``events`` (parsed, deduplicated) -> ``people`` (first activity) ->
    ``activity`` (rollup) -> ``weeks`` (person and week) -> ``features`` (one row per person)
    -> ``mart`` (with score and label). A written table cuts the lineage and survives the loss
    of executors. The raw log is taken as unchanging while the workspace is in use.
    """

    def __init__(
        self, spark: SparkSession, raw: DataFrame, settings: Settings | None = None, folder: str | None = None
    ):
        use_utc(spark)
        self.spark = spark
        self.raw = raw
        self.settings = settings or Settings()
        self._folder = folder
        self._own = folder is None
        self._noted = False
        self._tables: dict[str, DataFrame] = {}
        self._made: dict[str, Any] = {}
        self._lock = threading.RLock()

    @property
    def folder(self) -> str:
        if self._folder is None:
            self._folder = f"{shared_folder(self.spark)}/comeback-{uuid.uuid4().hex}"
        return self._folder

    def staged(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The stored table ``name``, built by ``build`` when asked for the first time."""
        with self._lock:
            if name not in self._tables:
                self._note_settings()
                self._tables[name] = write_table(build(), f"{self.folder}/{name}")
            return self._tables[name]

    def once(self, name: str, build: Callable[[], T]) -> T:
        """A fitted model or a plan with fetched constants, made when asked for the first time."""
        with self._lock:
            if name not in self._made:
                self._made[name] = build()
            return self._made[name]

    def _note_settings(self) -> None:
        """Keep the settings next to the tables they shaped."""
        if not self._noted:
            row = self.spark.createDataFrame([(json.dumps(asdict(self.settings)),)], "settings string")
            row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/settings")
            self._noted = True

    def close(self) -> None:
        """Delete the tables of a folder that this workspace made itself."""
        if self._own and self._folder is not None:
            remove_folder(self.spark, self._folder)
            self._folder = None
            self._noted = False
        self._tables.clear()
        self._made.clear()

    @classmethod
    def reopen(cls, spark: SparkSession, folder: str, settings: Settings | None = None) -> Workspace:
        """Work on the tables a previous session wrote to ``folder``.

        The tables hold what their settings made of the log, so other settings are refused;
        without ``settings`` the stored ones are taken.
        """
        use_utc(spark)
        stored = json.loads(spark.read.parquet(f"{folder}/settings").first()["settings"])
        if settings is None:
            tuples = {k: tuple(v) if isinstance(v, list) else v for k, v in stored.items()}
            names = {k: tuple(v) if isinstance(v, list) else v for k, v in stored["taxonomy"].items()}
            settings = Settings(**tuples | {"taxonomy": Taxonomy(**names)})
        given = json.loads(json.dumps(asdict(settings)))
        if other := sorted(k for k in given.keys() | stored.keys() if given.get(k) != stored.get(k)):
            raise ValueError(f"{folder} was built with other settings: {', '.join(other)}")
        events = spark.read.parquet(f"{folder}/events")
        workspace = cls(spark, events, settings, folder)
        for name in TABLES:
            workspace._tables[name] = spark.read.parquet(f"{folder}/{name}")
        workspace._noted = True
        return workspace

    @property
    def events(self) -> DataFrame:
        """Stored as the contract columns only; calendar and flags are computed when read."""
        kept = self.staged("events", lambda: keep_events(self.raw, self.settings))
        return self.once("events", lambda: describe_events(kept, self.settings))

    @property
    def people(self) -> DataFrame:
        return self.staged("people", lambda: act.first_activity(self.events))

    @property
    def activity(self) -> DataFrame:
        return self.staged("activity", lambda: act.activity_rollup(self.offsets(), self.settings))

    @property
    def weeks(self) -> DataFrame:
        return self.staged("weeks", lambda: features.person_weeks(self.activity, self.settings))

    @property
    def features(self) -> DataFrame:
        def build() -> DataFrame:
            names = features.most_frequent_events(self.activity, self.settings.top_events)
            return features.person_features(self.activity, self.weeks, self.settings, names)

        return self.staged("features", build)

    @property
    def mart(self) -> DataFrame:
        """Features with ratios, buckets, scores and label, the table most reports read."""

        def build() -> DataFrame:
            people = features.add_derived(self.features, self.settings)
            return scoring.add_label(scoring.add_scores(people, self.settings), self.settings)

        with self._lock:
            if "mart" in self._tables:
                return self._tables["mart"]
            # The projection has more columns than the JIT compiler takes as one method.
            with setting(self.spark, "spark.sql.codegen.hugeMethodLimit", JIT_METHOD_BYTES):
                return self.staged("mart", build)

    def offsets(self) -> DataFrame:
        """Events with their offsets; the count of the stored people decides how they are joined."""
        return act.event_offsets(self.events, self.people, self.settings, self.people.count())
