"""The driver's ``events`` table read as a product event log.

Every row of ``events`` is one event of the log. A user of the table stands for nine persons of
very different activity: the number in ``props`` (0 to 99) decides which of them acted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from comeback.config import Settings, Taxonomy
from comeback.functions.buckets import ladder
from comeback.sources.storage import use_utc

# Upper limits of the number in ``props`` for the persons 0 to 7 of a user; person 8 has the rest.
PERSON_LIMITS = (40, 60, 75, 85, 92, 96, 98, 99)
PLATFORMS = (None, " Windows ", "Windows", "Mac OS X", "Mac OS X", "Linux", "Linux")

TEST_TAXONOMY = Taxonomy(
    agent=("click_0", "click_1", "click_2", "click_3"),
    production=("purchase_0", "purchase_1", "purchase_2", "purchase_3"),
    collab=("signup_3", "view_3"),
    credit=("error_0", "error_1", "error_2", "error_3"),
    canvas=("view_0", "view_1", "view_2"),
    signup=("signup_0", "signup_1"),
    account_created="signup_0",
    published="purchase_0",
    scheduled="purchase_1",
    shared="signup_3",
    addon="error_0",
    upgrade=("error_0", "error_3"),
    opened_canvas="view_0",
    created_block="view_1",
)

TEST_SETTINGS = Settings(
    taxonomy=TEST_TAXONOMY, diverse_event_types=5, min_group_users=5, min_cohort_users=5
)


def _platform(event_id: Column) -> Column:
    chain = F.when(event_id % 7 == 0, F.lit(None).cast("string"))
    for remainder, name in enumerate(PLATFORMS[1:], start=1):
        chain = chain.when(event_id % 7 == remainder, name)
    return chain


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    use_utc(spark)
    events = spark.read.parquet(f"{folder}/events.parquet")
    number = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    person = ladder([number < limit for limit in PERSON_LIMITS], range(len(PERSON_LIMITS) + 1))
    event_id = F.col("event_id")
    return events.select(
        event_id.alias("uuid"),
        F.col("ts").alias("timestamp"),
        (F.col("user_id") * 10 + person).alias("person_id"),
        F.concat("event_type", F.lit("_"), (event_id % 4).cast("string")).alias("event"),
        _platform(event_id).alias("prop_$os"),
    )


def dirty_event_log(spark: SparkSession, folder: str) -> DataFrame:
    """The log with text times, some of them unreadable, and a tenth of the rows twice."""
    log = event_log(spark, folder)
    text = F.when(F.col("uuid") % 101 == 0, "not-a-date").otherwise(F.col("timestamp").cast("string"))
    dirty = log.withColumn("timestamp", text)
    return dirty.unionByName(dirty.filter(F.col("uuid") % 10 == 3))
