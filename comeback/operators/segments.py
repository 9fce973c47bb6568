"""Personas: standardised features, k-means, principal components, segment reports."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from comeback.functions.scalars import order_key, percent, round_half_even
from comeback.operators.learning import ID, ROWS_PER_PARTITION, Scaler
from comeback.operators.rates import flagged

#: Features are rounded to 1 / GRID, distances summed in 1 / MILLIONTHS.
GRID, MILLIONTHS = 1e9, 1e6
ELBOW = range(2, 9)
AXIS_STEPS = 500
#: Rows whose distances to all centres are computed at once; bits of the lower half of a summed number.
BLOCK_ROWS, HALF_BITS = 512, 26
#: Rows of a partition of the points, if the cluster has cores for so many; partitions whose sums the driver adds itself.
ROWS_PER_SCAN, FETCHED_PARTS = 5_000, 16

# Clustered features, persona names from the highest mean score down, radar axes.
CLUSTER_COLUMNS = (
    "total_events",
    "active_days",
    "tenure_days",
    "retention_score",
    "depth_score",
    "volume_score",
    "agent_ratio",
    "production_ratio",
    "ever_published_app",
    "ever_scheduled",
    "used_addon_credits",
)
PERSONAS = ("Power Users", "Casual Explorers", "Rising Stars", "One-time Visitors")
RADAR_COLUMNS = (
    "total_events",
    "active_days",
    "tenure_days",
    "retention_score",
    "depth_score",
    "success_score",
)


def standardised(mart: DataFrame, columns: Sequence[str] = CLUSTER_COLUMNS) -> DataFrame:
    """Person and the features as population z-scores."""
    filled = mart.select(ID, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    return filled.select(ID, *Scaler.fit(filled, columns).scaled())


def on_grid(scaled: DataFrame, columns: Sequence[str] = CLUSTER_COLUMNS) -> DataFrame:
    """Features rounded to billionths, so that sums over any rows in any order are exact."""
    return scaled.select(ID, *[(F.rint(F.col(c) * GRID) / GRID).alias(c) for c in columns])


@dataclass(frozen=True)
class Run:
    """Centres a start has come to, and the sum of squared distances to them, in millionths."""

    k: int
    start: int
    centres: tuple[tuple[float, ...], ...]
    inertia: int = 0


def first_centres(
    points: DataFrame, ks: Sequence[int], starts: int, seed: int, columns: Sequence[str] = CLUSTER_COLUMNS
) -> list[Run]:
    """``starts`` runs for every k: a start's centres are the first k rows in a hash order of its own."""
    most = max(ks)
    heads = [
        points.select(F.lit(start).alias("start"), order_key(F.col(ID), seed + start).alias("key"), ID, *columns)
        .orderBy("key", ID)
        .limit(most)
        for start in range(starts)
    ]
    rows = reduce(DataFrame.unionAll, heads).orderBy("start", "key", ID).collect()
    listed = {start: [tuple(float(r[c]) for c in columns) for r in rows if r["start"] == start] for start in range(starts)}
    return [Run(k, start, tuple(listed[start][:k])) for k in ks for start in range(starts)]


def advance(
    points: DataFrame, runs: Sequence[Run], columns: Sequence[str] = CLUSTER_COLUMNS, fetch_parts: bool = False
) -> list[tuple[Run, Run]]:
    """One scan for all runs: each with its inertia, and with its next centres.

    What is shuffled and fetched is a row per centre; with ``fetch_parts``, nothing is shuffled and such rows
    are fetched of every partition. An empty cluster keeps its centre; of equally near centres the first one counts.
    """
    width = len(columns)
    scan = _centre_scan([run.centres for run in runs], width)
    schema = "run int, cluster int, _users bigint, _inertia bigint, " + ", ".join(f"_sum{i} bigint" for i in range(width))
    sums = points.select(*columns).mapInArrow(scan, schema)
    if not fetch_parts:
        sums = sums.groupBy("run", "cluster").agg(*[F.sum(c).alias(c) for c in sums.columns[2:]])
    found: dict[tuple[int, int], tuple[int, ...]] = {}
    for run, cluster, *totals in sums.collect():
        held = found.get((run, cluster))
        found[run, cluster] = tuple(map(int.__add__, held, totals)) if held else tuple(totals)
    following = [[list(c) for c in run.centres] for run in runs]
    inertia = [0] * len(runs)
    for (run, cluster), (users, squares, *totals) in found.items():
        inertia[run] += squares
        if users:
            following[run][cluster] = [float(total) / users / GRID for total in totals]
    return [
        (Run(run.k, run.start, run.centres, inertia[i]), Run(run.k, run.start, tuple(map(tuple, following[i]))))
        for i, run in enumerate(runs)
    ]


def _centre_scan(
    centres: Sequence[Sequence[Sequence[float]]], width: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For every run's centre the rows nearest to it: their number, and the sums of their features in 1 / GRID.

    The run's squared distances, in millionths, are summed in the row of its first centre. Distances add
    the squares in the order of the columns. A centre's place is one array over all runs that have it,
    those with most centres first; whole numbers are summed as two halves, so that products of
    matrices of doubles are exact.
    """
    order = sorted((i for i, held in enumerate(centres) if held), key=lambda i: -len(centres[i]))
    places = [
        np.array([centres[i][at] for i in order if len(centres[i]) > at], dtype=np.float64)
        for at in range(max((len(held) for held in centres), default=0))
    ]

    def block(rows: np.ndarray, sums: list[np.ndarray], inertia: np.ndarray) -> None:
        count = rows.shape[1]
        least, nearest = np.empty((len(order), count)), np.zeros((len(order), count), np.int8)
        term, far = np.empty_like(least), np.empty_like(least)
        for at, place in enumerate(places):
            n = len(place)
            total = far[:n] if at else least
            total[:] = 0.0
            for i in range(width):
                np.subtract(rows[i][None, :], place[:, i, None], out=term[:n])
                np.multiply(term[:n], term[:n], out=term[:n])
                np.add(total, term[:n], out=total)
            if at:
                nearest[:n][total < least[:n]] = at
                np.minimum(least[:n], total, out=least[:n])
        inertia += np.rint(least * MILLIONTHS).astype(np.int64).sum(axis=1)
        whole = np.rint(rows * GRID).astype(np.int64)
        halves = np.vstack([np.ones((1, count)), whole >> HALF_BITS, whole & ((1 << HALF_BITS) - 1)]).T
        for at, place in enumerate(places):
            found = ((nearest[: len(place)] == at).astype(np.float64) @ halves).astype(np.int64)
            sums[at][:, 0] += found[:, 0]
            sums[at][:, 1:] += (found[:, 1 : width + 1] << HALF_BITS) + found[:, width + 1 :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(place), 1 + width), np.int64) for place in places]
        inertia = np.zeros(len(order), np.int64)
        for batch in batches:
            rows = np.array([batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)], dtype=np.float64)
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                block(np.ascontiguousarray(rows[:, at : at + BLOCK_ROWS]), sums, inertia)
        for at, found in enumerate(sums):
            held = inertia if at == 0 else np.zeros(len(found), np.int64)
            values = [np.array(order[: len(found)], np.int32), np.full(len(found), at, np.int32), found[:, 0], held, *found[:, 1:].T]
            names = ["run", "cluster", "_users", "_inertia", *(f"_sum{i}" for i in range(width))]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v)) for v in values], names=names)

    return run


def settled(old: Run, new: Run) -> bool:
    """Whether no centre moved by more than a hundred-thousandth of its place."""
    pairs = zip(old.centres, new.centres, strict=True)
    return all(abs(a - b) <= 1e-8 + 1e-5 * abs(b) for x, y in pairs for a, b in zip(x, y, strict=True))


def batched_kmeans(points: DataFrame, runs: Sequence[Run], iterations: int = 300) -> list[Run]:
    """All runs to their end, each step one scan for those still moving; ``points`` should be persisted."""
    active, done = list(runs), []
    few = points.rdd.getNumPartitions() <= FETCHED_PARTS
    for _ in range(iterations):
        if not active:
            break
        stepped = advance(points, active, fetch_parts=few)
        done += [old for old, new in stepped if settled(old, new)]
        active = [new for old, new in stepped if not settled(old, new)]
    return done + [old for old, _ in (advance(points, active) if active else [])]


def best_runs(runs: Sequence[Run]) -> dict[int, Run]:
    """For every k the run with the lowest inertia, the first start on ties."""
    best: dict[int, Run] = {}
    for run in sorted(runs, key=lambda r: (r.k, r.inertia, r.start)):
        best.setdefault(run.k, run)
    return best


def scan_layout(points: DataFrame, rows: int) -> DataFrame:
    """Rows dealt out evenly for scans that do much work a row: to all cores unless there are few rows."""
    cores = points.sparkSession.sparkContext.defaultParallelism
    parts = max(math.ceil(rows / ROWS_PER_PARTITION), min(math.ceil(rows / ROWS_PER_SCAN), cores))
    return points.repartition(max(1, parts))


def fit_clusters(mart: DataFrame, seed: int, ks: Sequence[int] = ELBOW, starts: int = 10) -> dict[int, Run]:
    """The best of several starts for every number of clusters, all advanced together."""
    points, rows = on_grid(standardised(mart)), mart.count()
    points = scan_layout(points, rows).persist()
    try:
        return best_runs(batched_kmeans(points, first_centres(points, ks, starts, seed)))
    finally:
        points.unpersist()


def elbow(spark: SparkSession, clusters: dict[int, Run]) -> DataFrame:
    """Lowest inertia for each number of clusters."""
    return spark.createDataFrame([(k, run.inertia / MILLIONTHS) for k, run in sorted(clusters.items())], "k int, inertia double")


def principal_axes(
    points: DataFrame, columns: Sequence[str] = CLUSTER_COLUMNS, axes: int = 2, steps: int = AXIS_STEPS
) -> list[list[float]]:
    """Directions of the largest variance: a one-pass covariance, then orthogonal iteration.

    A fixed number of steps from fixed directions (all ones, then ones of alternating sign in growing
    groups); each axis' entry of the largest size is positive. The driver gets the covariance.
    """
    n = len(columns)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    found = points.agg(*[F.covar_pop(columns[i], columns[j]) for i, j in pairs]).first()
    covariance = np.zeros((n, n))
    for (i, j), value in zip(pairs, found, strict=True):
        covariance[i, j] = covariance[j, i] = value or 0.0
    base = [np.array([-1.0 if axis and i >> (axis - 1) & 1 else 1.0 for i in range(n)]) for axis in range(axes)]
    for _ in range(steps):
        made: list[np.ndarray] = []
        for vector in base:
            image = covariance @ vector
            for other in made:
                image = image - (other @ image) * other
            size = math.sqrt(image @ image)
            made.append(image / size if size > 1e-12 else vector)
        base = made
    return [[float(x) * (1 if v[np.argmax(np.abs(v))] >= 0 else -1) for x in v] for v in base]


@dataclass(frozen=True)
class Personas:
    """Fitted clusters with their names and two axes of projection."""

    centres: tuple[tuple[float, ...], ...]
    axes: list[list[float]]
    names: dict[int, str]

    def assign(self, points: DataFrame) -> DataFrame:
        """Cluster, segment and both coordinates of points on the grid."""

        def along(axis: Sequence[float]) -> Column:
            return sum((F.col(c) * F.lit(a) for c, a in zip(CLUSTER_COLUMNS, axis, strict=True)), F.lit(0.0))

        return nearest_centre(points, self.centres).select(
            ID,
            F.col("cluster"),
            name_of(F.col("cluster"), self.names).alias("segment"),
            along(self.axes[0]).alias("pca_x"),
            along(self.axes[1]).alias("pca_y"),
        )


def name_of(code: Column, names: dict[int, str]) -> Column:
    pairs = [F.lit(part) for pair in names.items() for part in pair]
    return F.element_at(F.create_map(*pairs), code)


def fit_personas(mart: DataFrame, clusters: Run) -> Personas:
    """Name the clusters by descending mean success score, and find the axes to draw them along.

    The names do not depend on the cluster numbers, which differ between runs.
    """
    points = on_grid(standardised(mart))
    placed = nearest_centre(points, clusters.centres).select(ID, "cluster")
    means = placed.join(mart.select(ID, "success_score"), ID).groupBy("cluster")
    order = means.agg(F.avg("success_score").alias("m")).orderBy(F.desc("m"), "cluster").collect()
    names = {row["cluster"]: name for row, name in zip(order, PERSONAS)}
    return Personas(clusters.centres, principal_axes(points), names)


def segment_success(segmented: DataFrame) -> DataFrame:
    """Users, success rate, mean events and mean tenure per segment, best first."""
    groups = segmented.groupBy("segment").agg(
        F.count(ID).alias("users"),
        flagged("is_successful").alias("successful"),
        F.avg("total_events").alias("avg_events"),
        F.avg("tenure_days").alias("avg_tenure"),
    )
    rate = percent(F.col("successful"), F.col("users"))
    return groups.withColumn("success_rate", rate).orderBy(F.desc("success_rate"), "segment")


def segment_sizes(segmented: DataFrame) -> DataFrame:
    return segmented.groupBy("segment").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "segment")


def segment_profile(
    segmented: DataFrame, key: str = "segment", columns: Sequence[str] = (*CLUSTER_COLUMNS, "success_score")
) -> DataFrame:
    """Feature means per segment or cluster, two decimals."""
    means = [round_half_even(F.avg(c), 2).alias(c) for c in columns]
    return segmented.groupBy(key).agg(*means).orderBy(key)


def segment_radar(segmented: DataFrame) -> DataFrame:
    means = [F.avg(c).alias(c) for c in RADAR_COLUMNS]
    return segmented.groupBy("segment").agg(*means).orderBy("segment")


def segment_upgrade(segmented: DataFrame) -> DataFrame:
    rates = {"upgrade_rate": "is_upgrade_candidate", "success_rate": "is_successful"}
    return (
        segmented.groupBy("segment")
        .agg(
            F.count(ID).alias("users"),
            *[round_half_even(F.avg(c) * 100, 1).alias(name) for name, c in rates.items()],
        )
        .orderBy(F.desc("success_rate"), "segment")
    )


def seed_centres(scaled: DataFrame, k: int, columns: Sequence[str] = CLUSTER_COLUMNS) -> list[list[float]]:
    """The rows of the ``k`` smallest person ids as starting centres."""
    return [[row[c] for c in columns] for row in scaled.orderBy(ID).limit(k).collect()]


def nearest_centre(
    scaled: DataFrame, centres: Sequence[Sequence[float]], columns: Sequence[str] = CLUSTER_COLUMNS
) -> DataFrame:
    """Add ``cluster``, the nearest centre (the first on ties), and ``_least``, its squared distance."""
    squares = [
        sum(((F.col(c) - F.lit(x)) * (F.col(c) - F.lit(x)) for c, x in zip(columns, centre)), F.lit(0.0))
        for centre in centres
    ]
    placed = scaled.withColumn("_distances", F.array(*squares)).withColumn("_least", F.array_min("_distances"))
    return placed.withColumn("cluster", (F.array_position("_distances", F.col("_least")) - 1).cast("int"))


def lloyd_centres(
    scaled: DataFrame, k: int, steps: int, columns: Sequence[str] = CLUSTER_COLUMNS
) -> list[list[float]]:
    """Centres after a fixed number of steps from the seed centres; each step fetches ``k`` rows."""
    centres = seed_centres(scaled, k, columns)
    for _ in range(steps):
        centres = [[row[c] for c in columns] for row in lloyd_step(scaled, centres, columns).orderBy("cluster").collect()]
    return centres


def centre_segments(mart: DataFrame, steps: int = 2) -> DataFrame:
    """The mart with cluster and segment by nearest centre, named by descending mean success score."""
    scaled = standardised(mart)
    placed = nearest_centre(scaled, lloyd_centres(scaled, len(PERSONAS), steps)).select(ID, "cluster")
    segmented = mart.join(placed, ID)
    order = segmented.groupBy("cluster").agg(F.avg("success_score").alias("m")).orderBy(F.desc("m"), "cluster").collect()
    names = {row["cluster"]: name for row, name in zip(order, PERSONAS)}
    return segmented.withColumn("segment", name_of(F.col("cluster"), names))


def centre_elbow(mart: DataFrame, ks: Sequence[int] = ELBOW, steps: int = 1) -> DataFrame:
    """Sum of squared distances after a fixed number of steps from the seed centres, all k in one scan
    per step."""
    points = on_grid(standardised(mart))
    seeds = seed_centres(points, max(ks))
    runs = [Run(k, 0, tuple(map(tuple, seeds[:k]))) for k in ks]
    for _ in range(steps):
        runs = [new for _, new in advance(points, runs)]
    return elbow(mart.sparkSession, {run.k: run for run, _ in advance(points, runs)})


def lloyd_step(
    scaled: DataFrame, centres: Sequence[Sequence[float]], columns: Sequence[str] = CLUSTER_COLUMNS
) -> DataFrame:
    """Assign every row to its nearest centre (the first on ties) and return the new centres.

    ``inertia`` is the sum of squared distances to the old centre; an empty cluster keeps its
    centre. The centres are constants of the plan, so nothing but partial means is shuffled.
    """
    placed = nearest_centre(scaled, centres, columns)
    means = placed.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("users"),
        F.sum("_least").alias("inertia"),
        *[F.avg(c).alias(f"_mean_{c}") for c in columns],
    )
    rows = [(i, *map(float, centre)) for i, centre in enumerate(centres)]
    schema = "cluster int, " + ", ".join(f"`{c}` double" for c in columns)
    old = scaled.sparkSession.createDataFrame(rows, schema)
    return old.join(means, "cluster", "left").select(
        "cluster",
        F.coalesce("users", F.lit(0)).alias("users"),
        F.coalesce("inertia", F.lit(0.0)).alias("inertia"),
        *[F.coalesce(f"_mean_{c}", c).alias(c) for c in columns],
    )
