"""Staging helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from comeback.sources.storage import shared_folder, write_table


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path this module made, through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def staged(frame: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder and read back: cuts the lineage, survives lost executors."""
    return write_table(frame, scratch(frame.sparkSession, name))


@contextmanager
def one_pass(frame: DataFrame) -> Iterator[DataFrame]:
    """A stored copy that is deleted when the block ends; only fetched results may leave it."""
    path = scratch(frame.sparkSession, "pass")
    try:
        yield write_table(frame, path)
    finally:
        remove(frame.sparkSession, path)
