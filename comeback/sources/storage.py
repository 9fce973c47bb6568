"""Where intermediate tables, reports and models are written."""

from __future__ import annotations

import tempfile

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}


def use_utc(spark: SparkSession) -> None:
    """All times of a log are UTC: dates, hours and weeks don't depend on the session's time zone."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    named = named or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="comeback-")
    return _local_folders[context.applicationId]


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that holds it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def write_table(frame: DataFrame, path: str) -> DataFrame:
    """Write once, hand back the stored copy; the lineage ends at the files."""
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def write_report(frame: DataFrame, folder: str, name: str) -> str:
    """Store a report in its sorted order; returns the path."""
    path = f"{folder.rstrip('/')}/{name}"
    frame.write.mode("overwrite").parquet(path)
    return path


def save_model(model: PipelineModel, folder: str, name: str) -> str:
    path = f"{folder.rstrip('/')}/{name}"
    model.write().overwrite().save(path)
    return path


def load_model(folder: str, name: str) -> PipelineModel:
    return PipelineModel.load(f"{folder.rstrip('/')}/{name}")
