"""Order-dependent results that no single task has to hold: running totals, ranks, quantiles.

A window without partition keys (or with a two-valued label as key) would sort everything in
one task. Here rows are first cut into value ranges, as many as the data ask for; the totals of
earlier ranges are a small table that is broadcast, and windows only run inside one range.
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from comeback.functions.scalars import KEY_MODULUS, passed_limits

RANK_BUCKETS = 4096
ROWS_PER_RANGE = 1_000_000
RANGES_PER_BLOCK = 1024


def value_bounds(frame: DataFrame, value: str, by: Sequence[str], buckets: int) -> DataFrame:
    """Range limits per group as a local table of at most ``buckets`` numbers per group.

    The limits are fetched once so that every later use sees the same ones; they only have to
    be balanced, not exact.
    """
    shares = [i / buckets for i in range(1, buckets)]
    limits = frame.groupBy(*by).agg(
        F.percentile_approx(F.col(value).cast("double"), shares, 20 * buckets).alias("_limits")
    )
    local = [
        (*[row[name] for name in by], sorted(set(row["_limits"] or [])))
        for row in limits.collect()
    ]
    schema = T.StructType(
        [
            *[frame.schema[name] for name in by],
            T.StructField("_limits", T.ArrayType(T.DoubleType())),
        ]
    )
    return frame.sparkSession.createDataFrame(local, schema)


def value_ranges(
    frame: DataFrame, value: str, by: Sequence[str] = (), rows_per_range: int = ROWS_PER_RANGE
) -> tuple[DataFrame, int]:
    """Add ``_range``, the number of the row's value range in its group, and say how many there are.

    Ranges follow the size of the largest group, so one holds about ``rows_per_range`` distinct
    values (four times as many at most, by the sketch's error) however many rows there are. A row's
    range is found by halving. Up to ``rows_per_range`` rows there is one range and nothing is fetched
    but the count.
    """
    by = list(by)
    sizes = frame.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).agg(F.max("_rows")).first()
    ranges = math.ceil(((sizes and sizes[0]) or 0) / rows_per_range)
    if ranges <= 1:
        return frame.withColumn("_range", F.lit(0)), 1
    limits = value_bounds(frame, value, by, ranges)
    if by:
        placed = frame.join(F.broadcast(limits), by, "left")
    else:
        placed = frame.crossJoin(F.broadcast(limits))
    below = passed_limits(F.col("_limits"), F.col(value).cast("double"), ranges, equal=False)
    return placed.withColumn("_range", below).drop("_limits"), ranges


def running_totals(
    frame: DataFrame,
    value: str,
    measures: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add ``cum_<measure>``: the total of each measure up to and including this value.

    ``frame`` holds one row per (``by``, ``value``). ``by`` names report-sized groups. Totals add
    up on two levels: of earlier ranges (blocks of ranges first, then ranges inside a block), and of
    earlier values inside a range.
    """
    by = list(by)
    placed, ranges = value_ranges(frame, value, by, rows_per_range)

    def direction(name: str) -> Column:
        return F.col(name).desc() if descending else F.col(name).asc()

    inside = (
        Window.partitionBy(*by, "_range").orderBy(direction(value)).rowsBetween(Window.unboundedPreceding, 0)
    )
    if ranges == 1:
        return placed.select(*frame.columns, *[F.sum(m).over(inside).alias(f"cum_{m}") for m in measures])

    def earlier(rows: DataFrame, key: str, within: Sequence[str]) -> DataFrame:
        window = Window.partitionBy(*within).orderBy(direction(key)).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumns({f"_before_{m}": F.coalesce(F.sum(m).over(window), F.lit(0)) for m in measures})

    sums = [F.sum(m).alias(m) for m in measures]
    per_range = placed.groupBy(*by, "_range").agg(*sums).withColumn("_block", F.floor(F.col("_range") / RANGES_PER_BLOCK))
    blocks = earlier(per_range.groupBy(*by, "_block").agg(*sums), "_block", by)
    blocks = blocks.select(*by, "_block", *[F.col(f"_before_{m}").alias(f"_blocks_{m}") for m in measures])
    before = earlier(per_range, "_range", [*by, "_block"]).join(F.broadcast(blocks), [*by, "_block"])
    before = before.select(*by, "_range", *[(F.col(f"_before_{m}") + F.col(f"_blocks_{m}")).alias(f"_before_{m}") for m in measures])
    totals = placed.join(F.broadcast(before), [*by, "_range"])
    return totals.select(
        *frame.columns,
        *[(F.col(f"_before_{m}") + F.sum(m).over(inside)).alias(f"cum_{m}") for m in measures],
    )


def shuffled_rank(
    frame: DataFrame, key: Column, tie_break: str, strata: Sequence[str] = (), name: str = "position"
) -> DataFrame:
    """Add the 1-based position of each row inside its stratum when ordered by a hash key.

    ``key`` is a number in [0, 2^32), evenly spread by construction, so equal-width ranges
    are balanced.
    """
    strata = list(strata)
    width = KEY_MODULUS // RANK_BUCKETS
    placed = frame.withColumn("_key", key).withColumn("_range", F.floor(F.col("_key") / width))
    per_range = placed.groupBy(*strata, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*strata).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = per_range.select(
        *strata, "_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*strata, "_range").orderBy("_key", tie_break)
    ranked = placed.join(F.broadcast(before), [*strata, "_range"])
    return ranked.select(
        *frame.columns, (F.col("_before") + F.row_number().over(inside)).cast("bigint").alias(name)
    )


def cut_points(
    frame: DataFrame,
    key: Column,
    tie_break: str,
    strata: Sequence[str],
    positions: Callable[[Column], Sequence[Column]],
) -> DataFrame:
    """The rows at certain positions of each stratum's hash order: ``cuts``, an array with one
    (key, tie-break) per position, null where the position is 0.

    ``positions`` makes them from the stratum's size. Ranges of the key are counted; only the one
    range that holds a position is ranked, by key and tie-break alone. So rows are compared with a
    few constants afterwards, and no column of ``frame`` is shuffled.
    """
    strata = list(strata)
    width = KEY_MODULUS // RANK_BUCKETS
    placed = frame.select(*strata, key.alias("_key"), F.col(tie_break).alias("_tie"))
    placed = placed.withColumn("_range", F.floor(F.col("_key") / width))
    per_range = placed.groupBy(*strata, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    ranges = per_range.select(
        *strata,
        "_range",
        F.sum("_rows").over(Window.partitionBy(*strata).orderBy("_range")).alias("_last"),
        "_rows",
        F.sum("_rows").over(Window.partitionBy(*strata)).alias("_size"),
    )
    wanted = ranges.select("*", F.posexplode(F.array(*[p.cast("bigint") for p in positions(F.col("_size"))])).alias("_n", "_position"))
    wanted = wanted.withColumn("_position", F.least("_position", "_size"))
    # A position of 0 is noted at the stratum's first range and matches no row.
    first = F.col("_last") == F.col("_rows")
    holds = (F.col("_position") > F.col("_last") - F.col("_rows")) & (F.col("_position") <= F.col("_last"))
    wanted = wanted.where(holds | (first & (F.col("_position") <= 0)))
    wanted = wanted.select(*strata, "_range", "_n", (F.col("_position") - F.col("_last") + F.col("_rows")).alias("_at"))
    targets = wanted.groupBy(*strata, "_range").agg(F.collect_list(F.struct("_n", "_at")).alias("_targets"))
    near = placed.join(F.broadcast(targets), [*strata, "_range"])
    inside = Window.partitionBy(*strata, "_range").orderBy("_key", "_tie")
    ranked = near.withColumn("_at", F.row_number().over(inside)).select(*strata, "_key", "_tie", "_at", F.inline("_targets").alias("_n", "_want"))
    point = F.when(F.col("_at") == F.col("_want"), F.struct("_key", "_tie"))
    met = ranked.where("_at = _want or (_want <= 0 and _at = 1)").select(*strata, "_n", point.alias("_cut"))
    both = F.array_sort(F.collect_list(F.struct("_n", "_cut")))
    return met.groupBy(*strata).agg(F.transform(both, lambda c: c["_cut"]).alias("cuts"))


def passed_cuts(frame: DataFrame, key: Column, tie_break: str, strata: Sequence[str], cuts: DataFrame) -> DataFrame:
    """Add ``_passed``: how many of its stratum's cut points lie before the row."""
    strata = list(strata)
    joined = frame.join(F.broadcast(cuts), strata) if strata else frame.crossJoin(F.broadcast(cuts))
    here = F.struct(key.alias("_key"), F.col(tie_break).alias("_tie"))
    before = F.filter("cuts", lambda cut: cut.isNull() | (cut < here))
    return joined.select(*frame.columns, F.size(before).alias("_passed"))


def exact_quantile(
    frame: DataFrame, value: str, share: float, small: int = 100_000, accuracy: int = 10_000
) -> float | None:
    """Exact quantile with linear interpolation between the two neighbouring order statistics.

    Each round asks a mergeable sketch for two values enclosing the wanted ranks and counts
    what lies below and between them; no row is moved. When at most ``small`` rows are left in
    between (or all of them are equal), their distinct values are fetched.
    """
    present = frame.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull()).persist()
    try:
        return _quantile_of(present, share, small, accuracy)
    finally:
        present.unpersist()


def _quantile_of(present: DataFrame, share: float, small: int, accuracy: int) -> float | None:
    total = present.count()
    if total == 0:
        return None
    at = share * (total - 1)
    first, last = math.floor(at), math.ceil(at)
    inside, below, size = present, 0, total
    while size > small:
        margin = 2 / accuracy
        shares = [
            max((first - below) / size - margin, 0.0),
            min((last - below + 1) / size + margin, 1.0),
        ]
        low, high = inside.agg(F.percentile_approx("v", shares, accuracy)).first()[0]
        passed, enclosed = inside.agg(
            F.count_if(F.col("v") < low), F.count_if(F.col("v").between(low, high))
        ).first()
        covered = below + passed <= first and last < below + passed + enclosed
        if not covered or (enclosed == size and low < high):
            accuracy *= 10
            continue
        inside, below, size = inside.filter(F.col("v").between(low, high)), below + passed, enclosed
        if low == high:
            break
    counts = inside.groupBy("v").count().orderBy("v").collect()
    ends = list(itertools.accumulate((row["count"] for row in counts), initial=below))

    def at_rank(rank: int) -> float:
        return counts[bisect.bisect_right(ends, rank) - 1]["v"]

    return at_rank(first) + (at_rank(last) - at_rank(first)) * (at - first)
