"""Small tables for the operators on documents."""

from __future__ import annotations

import duckdb
from pyspark.sql import DataFrame, SparkSession

DATA = "/root/testdata"


def documents(scale: str) -> list[tuple[int, str]]:
    return duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/{scale}/documents.parquet' ORDER BY doc_id").fetchall()


def frame(spark: SparkSession, rows: list[tuple[int | None, str | None]], extra: bool = False) -> DataFrame:
    """(doc_id, text); with ``extra``, columns named like results and helpers of the operators."""
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    if extra:
        for name in "row words h chunk shard n n_words items best kept labels lang key size".split():
            docs = docs.selectExpr("*", f"1 AS {name}")
    return docs
