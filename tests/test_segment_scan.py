"""The scan of k-means over all runs: exact against plain arrays, spread over the cores, fast."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from comeback.operators import segments

COLUMNS = [f"x{i}" for i in range(len(segments.CLUSTER_COLUMNS))]


def cloud(spark, rows):
    values = [F.round(F.randn(i) * 3, 1).alias(c) for i, c in enumerate(COLUMNS)]
    return spark.range(rows, numPartitions=4).select(F.col("id").alias("person_id"), *values)


def plain(matrix, centres):
    """Inertia in millionths and next centres of one run, row after row in whole numbers."""
    sums, users, inertia = [[0] * matrix.shape[1] for _ in centres], [0] * len(centres), 0
    for row in matrix.tolist():
        far = []
        for centre in centres:
            total = 0.0
            for a, b in zip(row, centre):
                total += (a - b) * (a - b)
            far.append(total)
        at = far.index(min(far))
        users[at] += 1
        inertia += round(min(far) * 1e6)
        sums[at] = [s + round(v * 1e9) for s, v in zip(sums[at], row)]
    following = [tuple(float(s) / n / 1e9 for s in held) if n else tuple(c) for held, n, c in zip(sums, users, centres)]
    return inertia, tuple(following)


def test_scan_equals_plain_numbers(spark):
    points = cloud(spark, 1_500)
    matrix = np.array([[r[c] for c in COLUMNS] for r in points.collect()])
    first = tuple(map(tuple, matrix[:8].tolist()))
    runs = [segments.Run(k, start, first[start : start + k]) for k in (2, 5, 7) for start in (0, 1)]
    # Equal centres, of which the first one counts, and one that no row is near to.
    runs.append(segments.Run(4, 9, (first[0], first[1], first[1], (1e4,) * len(COLUMNS))))
    runs.append(segments.Run(3, 9, ()))
    stepped = segments.advance(points.repartition(3), runs, COLUMNS)
    assert stepped == segments.advance(points.repartition(5), runs, COLUMNS, fetch_parts=True)
    for run, (old, new) in zip(runs, stepped, strict=True):
        inertia, following = plain(matrix, run.centres) if run.centres else (0, ())
        assert (old.k, old.start, old.centres, old.inertia) == (run.k, run.start, run.centres, inertia)
        assert new.centres == following


def test_scan_of_no_rows_keeps_the_centres(spark):
    runs = [segments.Run(2, 0, ((0.0,) * len(COLUMNS), (1.0,) * len(COLUMNS)))]
    assert segments.advance(cloud(spark, 0), runs, COLUMNS) == [(runs[0], runs[0])]


@pytest.mark.parametrize("rows, parts", [(1, 1), (segments.ROWS_PER_SCAN * 2, 2)])
def test_few_points_use_several_cores(spark, rows, parts):
    placed = segments.scan_layout(cloud(spark, rows), rows)
    assert placed.rdd.getNumPartitions() == min(parts, spark.sparkContext.defaultParallelism)


def test_scan_takes_microseconds_a_row(spark):
    """70 runs over 30,000 rows; with functions of arrays in the plan, evaluated number by number, this took 15 s of CPU."""
    points = cloud(spark, 30_000).persist()
    heads = [tuple(r[c] for c in COLUMNS) for r in points.limit(90).collect()]
    runs = [segments.Run(k, start, tuple(heads[start : start + k])) for k in range(2, 9) for start in range(10)]
    segments.advance(points, runs[:2], COLUMNS)
    began = time.time()
    segments.advance(points.coalesce(1), runs, COLUMNS)
    assert time.time() - began < 6
    points.unpersist()
