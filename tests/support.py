"""Session and comparison helpers shared by the tests and the comparison tool."""

from __future__ import annotations

import os
from collections.abc import Sequence

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def local_session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    session = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("comeback")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def open_duckdb(folder: str) -> duckdb.DuckDBPyConnection:
    database = duckdb.connect()
    for table in TABLES:
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return database


def normalised(columns: Sequence[str], rows: list[tuple]) -> list[tuple]:
    """Rows with columns in name order, sorted, for an order-insensitive exact comparison."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)
