"""Connected components of a graph given as rows of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comeback.llm.common import remove, scratch
from comeback.sources.storage import write_table


def connected(links: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """(node, component) of every linked node; the component is its smallest node.

    Each round hangs the larger neighbours of a node under its smallest one, then the smaller
    ones (large-star, small-star), until nothing changes: a few rounds for any shape of graph.
    Minima are combined before the shuffle; the joins back to a node with very many links are
    left to the adaptive skew join. Every round is written to the shared folder, and the one
    before deleted. Null ends and links of a node with itself are left out.
    """
    spark = links.sparkSession

    def store(frame: DataFrame) -> tuple[DataFrame, str]:
        path = scratch(spark, "links")
        return write_table(frame, path), path

    def mark(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first())

    high, low = F.greatest(first, second), F.least(first, second)
    start = links.where(F.col(first).isNotNull() & F.col(second).isNotNull() & (F.col(first) != F.col(second)))
    current, path = store(start.select(high.alias("high"), low.alias("low")).distinct())
    state = mark(current)
    while state[0]:
        both = current.select(F.col("high").alias("u"), F.col("low").alias("v")).unionAll(
            current.select(F.col("low").alias("u"), F.col("high").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("high"), F.col("m").alias("low")).where("high <> low").distinct()
        below = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(below, "high").select(F.explode(F.array(
            F.struct(F.col("high").alias("high"), F.col("m").alias("low")),
            F.struct(F.col("low").alias("high"), F.col("m").alias("low")),
        )).alias("e")).select("e.*").where("high <> low").distinct()
        following, new_path = store(small)
        new_state = mark(following)
        remove(spark, path)
        current, path = following, new_path
        if new_state == state:
            break
        state = new_state
    members = current.select(F.col("high").alias("node"), F.col("low").alias("component"))
    roots = current.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return members.unionAll(roots)
