"""One row per person: behaviour counts, windows, flags, matrix, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from comeback.config import Settings
from comeback.functions import buckets
from comeback.functions.scalars import column_slug, elapsed_hours, whole_days

# Feature and milestone names.
EARLY_COLUMNS = (
    "d3_total_events",
    "d3_agent_events",
    "d3_production_events",
    "d3_canvas_events",
    "d3_unique_events",
    "d3_active_days",
)
FIRST_WEEK_COLUMNS = (
    "fw_total_events",
    "fw_agent_events",
    "fw_production_events",
    "fw_canvas_events",
    "fw_unique_events",
    "fw_active_days",
)
MILESTONES = ("did_run_code", "did_use_agent", "did_publish", "did_return_week2", "did_diverse_events")


def event_frequency(activity: DataFrame) -> DataFrame:
    """Events per name, most frequent first, name as tie-break."""
    counts = activity.filter(F.col("event").isNotNull()).groupBy("event").agg(F.sum("n").alias("count"))
    return counts.orderBy(F.desc("count"), "event")


def most_frequent_events(activity: DataFrame, limit: int) -> list[str]:
    """Names of the ``limit`` most frequent events; the pivot needs them before planning."""
    return [row["event"] for row in event_frequency(activity).limit(limit).collect()]


def event_dimension(
    spark: SparkSession, named: dict[str, tuple[str, ...]], matrix_events: Sequence[str]
) -> DataFrame:
    """Per known event name: one bit per group it belongs to, and its matrix slot.

    Its rows come from the configuration, so it is small whatever the data.
    """
    bits = {kind: 1 << i for i, kind in enumerate(named)}
    slots = {name: i for i, name in enumerate(matrix_events)}
    known = sorted(set(slots).union(*named.values()))
    rows = [(n, sum(bit for kind, bit in bits.items() if n in named[kind]), slots.get(n)) for n in known]
    return spark.createDataFrame(rows, "event string, mask int, slot int")


def _known(activity: DataFrame, *columns: str | Column) -> DataFrame:
    return activity.filter(F.col("person_id").isNotNull()).select("person_id", *columns)


def event_counts(activity: DataFrame, settings: Settings, matrix_events: Sequence[str]) -> DataFrame:
    """Everything counted from event names: totals, categories, windows, flags, matrix.

    Events are first summed per (person, name), combined before they are shuffled. A distinct
    count inside a window is then the number of names whose first offset lies in the window, so
    no distinct aggregate is needed. Only these sums, one row per name a person ever used, are
    brought to the person; the wide row of measures is made there and not shuffled again.
    """
    taxonomy = settings.taxonomy
    categories = taxonomy.categories()
    flags = {
        "ever_published_app": (taxonomy.published,),
        "ever_scheduled": (taxonomy.scheduled,),
        "ever_shared": (taxonomy.shared,),
        "used_addon_credits": (taxonomy.addon,),
        "is_upgrade_candidate": taxonomy.upgrade,
    }
    stages = {
        "opened_canvas": (taxonomy.opened_canvas,),
        "created_block": (taxonomy.created_block,),
    }
    named = {**categories, **flags, **stages, "signup": taxonomy.signup}
    bits = {kind: 1 << i for i, kind in enumerate(named)}
    windows = {"week": settings.first_week_days, "early": settings.early_days}

    rows = _known(activity, "event", "n", "n_ids", "days_since_first", "first_at", "last_at")
    sums = {
        f"{amount}_{window}": f"sum(if(days_since_first <= {days}, {amount}, 0))"
        for window, days in windows.items()
        for amount in ("n", "n_ids")
    }
    per_name = rows.groupBy("person_id", "event").agg(
        F.sum("n").alias("n"),
        F.sum("n_ids").alias("n_ids"),
        *[F.expr(text).alias(name) for name, text in sums.items()],
        F.min("days_since_first").alias("first_offset"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
    )
    dimension = event_dimension(activity.sparkSession, named, matrix_events)
    placed = per_name.repartition("person_id").join(F.broadcast(dimension), "event", "left")
    placed = placed.fillna({"mask": 0, "slot": -1})

    def of(kind: str) -> str:
        return f"(mask & {bits[kind]}) <> 0"

    def window(prefix: str, suffix: str, kinds: Sequence[str]) -> dict[str, str]:
        return {
            f"{prefix}_total_events": f"sum(n_ids_{suffix})",
            **{f"{prefix}_{kind}_events": f"sum(if({of(kind)}, n_{suffix}, 0))" for kind in kinds},
            f"{prefix}_unique_events": f"count_if(event IS NOT NULL AND first_offset <= {windows[suffix]})",
        }

    measures = {
        "total_events": "sum(n_ids)",
        "unique_event_types": "count(event)",
        "first_seen": "min(first_at)",
        "last_seen": "max(last_at)",
        **{f"{kind}_events": f"sum(if({of(kind)}, n, 0))" for kind in categories},
        **window("fw", "week", list(categories)),
        **window("d3", "early", ("agent", "production", "canvas")),
        **{name: f"if((bit_or(mask) & {bits[name]}) <> 0, 1, 0)" for name in flags},
        **{f"{name}_events": f"sum(if({of(name)}, n, 0))" for name in stages},
        # Earliest named event, the smallest name among simultaneous ones.
        "first_event": "min(if(event IS NOT NULL, struct(first_at, event), NULL)).event",
        "first_agent_ts": f"min(if({of('agent')}, first_at, NULL))",
        "first_value_ts": f"min(if({of('production')}, first_at, NULL))",
        "first_signup_ts": f"min(if({of('signup')}, first_at, NULL))",
        **{
            column_slug("evt_", name): f"sum(if(slot = {slot}, n, 0))"
            for slot, name in enumerate(matrix_events)
        },
    }
    return placed.groupBy("person_id").agg(*[F.expr(text).alias(name) for name, text in measures.items()])


def person_weeks(activity: DataFrame, settings: Settings) -> DataFrame:
    """One row per person and active calendar week, with one bit per active weekday.

    ``fw_days`` and ``d3_days`` keep only the days of the first-week and early windows.
    """
    monday = F.date_trunc("week", "date").cast("date").alias("monday")
    bit = F.expr("1 << weekday(date)").alias("bit")
    rows = _known(activity, monday, "week_key", "week", "weeks_since_first", "days_since_first", bit)
    return rows.groupBy("person_id", "monday", "week_key", "week", "weeks_since_first").agg(
        F.bit_or("bit").alias("days"),
        F.expr(f"bit_or(if(days_since_first <= {settings.first_week_days}, bit, 0))").alias("fw_days"),
        F.expr(f"bit_or(if(days_since_first <= {settings.early_days}, bit, 0))").alias("d3_days"),
    )


def active_time(weeks: DataFrame, settings: Settings) -> DataFrame:
    """Distinct active days (lifetime and per window) and weeks, and the last week offset."""
    # ISO numbers repeat every year and count once; they fit the bits of a long.
    distinct = "count(1)" if settings.week_mode == "continuous" else "bigint(bit_count(bit_or(1L << week)))"
    return weeks.groupBy("person_id").agg(
        F.expr("sum(bit_count(days))").alias("active_days"),
        F.expr(distinct).alias("active_weeks"),
        F.expr("sum(bit_count(fw_days))").alias("fw_active_days"),
        F.expr("sum(bit_count(d3_days))").alias("d3_active_days"),
        F.max("weeks_since_first").alias("weeks_reached"),
    )


def usual_platform(activity: DataFrame) -> DataFrame:
    """Most frequent operating system per person, the smallest name on ties."""
    per_os = _known(activity, "os", "n").groupBy("person_id", "os").agg(F.sum("n").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("rank"), "os"))
    return per_os.groupBy("person_id").agg(best.getField("os").alias("os_platform"))


def person_features(
    activity: DataFrame, weeks: DataFrame, settings: Settings, matrix_events: Sequence[str]
) -> DataFrame:
    """Lifetime, first-week and early aggregates plus the event matrix, one row per person.

    Columns that follow from these (``add_derived``) are left to the reader. Every part ends
    partitioned by person, so their joins find both sides in place.
    """
    counts = event_counts(activity, settings, matrix_events)
    for part in (active_time(weeks, settings), usual_platform(activity)):
        counts = counts.join(part, "person_id")
    return counts


def add_derived(people: DataFrame, settings: Settings) -> DataFrame:
    """Per-row consequences: ratios with smoothed denominators, elapsed times, buckets, milestones."""
    events, days, weeks = F.col("total_events"), F.col("active_days"), F.col("active_weeks")
    first = F.col("first_seen")
    ratios = {f"{kind}_ratio": F.col(f"{kind}_events") / (events + 1) for kind in settings.taxonomy.categories()}
    timed = people.withColumns(
        {
            "tenure_days": whole_days(first, F.col("last_seen")),
            "events_per_day": events / (days + 1),
            **ratios,
            "weekly_cadence": days / (weeks + 1),
            "hours_to_first_agent": elapsed_hours(first, F.col("first_agent_ts")),
            "hours_to_first_value": elapsed_hours(first, F.col("first_value_ts")),
            "signup_hour": F.hour("first_signup_ts"),
            "did_run_code": (F.col("production_events") > 0).cast("int"),
            "did_use_agent": (F.col("agent_events") > 0).cast("int"),
            "did_publish": F.col("ever_published_app"),
            "did_return_week2": (weeks >= settings.return_weeks).cast("int"),
            "did_diverse_events": (F.col("unique_event_types") >= settings.diverse_event_types).cast("int"),
        }
    )
    return timed.withColumns(
        {
            "agent_speed": buckets.agent_speed(F.col("hours_to_first_agent"), settings),
            "ttv_bucket": buckets.time_to_value(F.col("hours_to_first_value"), settings),
            "signup_period": buckets.signup_period(F.col("signup_hour")),
            "milestones_hit": sum((F.col(m) for m in MILESTONES), F.lit(0)),
        }
    )


def matrix_columns(people: DataFrame) -> list[str]:
    return [name for name in people.columns if name.startswith("evt_")]
