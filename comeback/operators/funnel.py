"""Activation funnel and its drop-off."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from comeback.config import Settings
from comeback.functions.scalars import percent, percent_text, round_half_even
from comeback.operators.trends import rows_from

# Stage names in order.
STAGES = (
    "1. Signed Up",
    "2. Opened a Canvas",
    "3. Created a Block",
    "4. Used Agent",
    "5. Ran Code",
    "6. Active 7+ Days",
    "7. Published / Scheduled",
    "8. Successful (Top 30%)",
)


def user_funnel(mart: DataFrame, settings: Settings) -> DataFrame:
    """Users passing each stage, counted independently in one pass."""
    tests = [
        F.lit(True),
        F.col("opened_canvas_events") > 0,
        F.col("created_block_events") > 0,
        F.col("agent_events") > 0,
        F.col("production_events") > 0,
        F.col("tenure_days") >= settings.retained_days,
        F.greatest("ever_published_app", "ever_scheduled") == 1,
        F.col("is_successful") == 1,
    ]
    totals = mart.agg(*[F.count_if(test).alias(f"s{i}") for i, test in enumerate(tests)])
    long = rows_from(totals, "stage", "users", [(name, F.col(f"s{i}")) for i, name in enumerate(STAGES)])
    first = F.max(F.when(F.col("position") == 1, F.col("users"))).over(Window.partitionBy())
    share = percent(F.col("users"), first)
    return long.withColumn("pct_of_first", share).withColumn(
        "pct_text", percent_text(F.col("pct_of_first"), "% of signups")
    )


def funnel_dropoff(funnel: DataFrame) -> DataFrame:
    """Users lost between consecutive stages; the funnel has eight rows."""
    order = Window.orderBy("position")
    before = F.lag("users").over(order)
    lost = F.coalesce(percent(before - F.col("users"), before), F.lit(0.0))
    steps = funnel.select(
        "position",
        F.lag("stage").over(order).alias("from_stage"),
        F.col("stage").alias("to_stage"),
        (before - F.col("users")).alias("lost"),
        round_half_even(lost, 1).alias("pct_lost"),
    )
    return steps.filter(F.col("from_stage").isNotNull()).orderBy("position")
