"""The event log: contract, reading and profiling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from comeback.operators.cleaning import parsed_time
from comeback.sources.storage import use_utc

EVENT_COLUMNS = ("person_id", "uuid", "event", "timestamp", "prop_$os")

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("person_id", T.StringType()),
        T.StructField("uuid", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("prop_$os", T.StringType()),
    ]
)


def read_events(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Scan a Parquet event log, however wide; only the contract columns are read.

    ``schema`` skips the footer inspection when the types are known.
    """
    use_utc(spark)
    reader = spark.read if schema is None else spark.read.schema(schema)
    log = reader.parquet(path)
    missing = [name for name in EVENT_COLUMNS if name not in log.columns]
    if missing:
        raise ValueError(f"event log {path} lacks columns {missing}")
    return log.select(*[F.col(f"`{name}`") for name in EVENT_COLUMNS])


def dataset_profile(raw: DataFrame, approximate: bool = False) -> DataFrame:
    """Row, column, user and event counts with the time range, in one pass.

    ``approximate`` replaces the two exact distinct counts with HyperLogLog++ sketches.
    """
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    at = parsed_time(raw)
    return raw.select("person_id", "event", at.alias("at")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(raw.columns)).cast("bigint").alias("n_columns"),
        distinct("person_id").alias("n_users"),
        distinct("event").alias("n_events"),
        F.min("at").cast("timestamp_ntz").alias("first_timestamp"),
        F.max("at").cast("timestamp_ntz").alias("last_timestamp"),
        F.sum(F.col("at").isNull().cast("bigint")).alias("bad_timestamps"),
    )


def head_rows(frame: DataFrame, by: str = "uuid", rows: int = 5) -> DataFrame:
    """The first rows in the order of a column, for display; each task keeps its own first ones."""
    return frame.orderBy(by).limit(rows)
