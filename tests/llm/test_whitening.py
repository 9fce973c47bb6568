"""Whitening against numpy and exact whole numbers."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest

from comeback.llm import queries, whitening
from comeback.llm.whitening import Whitening
from tests.llm.fixtures import DATA

SCHEMA = "vec_id bigint, embedding array<float>"


def table(spark, rows):
    extra = "1 AS x", "2 AS n", "3 AS block", "4 AS whitened", "5 AS data"
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", *extra)


def brute(vectors, components=32):
    """n, deviations (whole numbers), projections up to sign, explained shares."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n = len(x)
    sums = [sum(column) for column in zip(*x, strict=True)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array(x, float) - np.array(sums) / n
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:components]
    return n, deviations, centred @ axes[:, order] / np.sqrt(values[order]), values[order] / np.trace(covariance)


def compare(rows, ids, vectors, components=32, tolerance=1e-6):
    n, deviations, want, explained = brute(vectors, components)
    k = want.shape[1]
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(rows) == len(got) == len(ids) * k
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] <= 1e-4
    table_ = np.array([[got[i, c + 1]["whitened"] for c in range(k)] for i in ids])
    for c in range(k):
        apart = min(np.abs(table_[:, c] - want[:, c]).max(), np.abs(table_[:, c] + want[:, c]).max())
        assert apart < tolerance, (c, apart)
        assert all(got[i, c + 1]["explained"] == pytest.approx(explained[c], rel=1e-9) for i in ids)
    assert all(got[i, 1]["deviation"] == d and got[i, 1]["n"] == n for i, d in zip(ids, deviations, strict=True))


@pytest.mark.parametrize("rule", [Whitening(), Whitening(components=3, block_rows=16, task_rows=40), Whitening(block_rows=7, task_rows=7)])
def test_random(spark, rule):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) + [3, -100, 0, 0, 9]).astype(np.float32)
    docs = table(spark, [(i, v.tolist()) for i, v in enumerate(vectors)])
    rows = whitening.by_component(whitening.whiten(docs, rule)).collect()
    compare(rows, range(300), vectors, rule.components)


def test_odd_rows(spark):
    """Nulls, other lengths, no finite number; a constant direction; ids that repeat or are null."""
    rng = np.random.default_rng(2)
    good = [(i, [float(a), float(b), 7.0]) for i, (a, b) in enumerate(rng.normal(size=(40, 2)))]
    odd = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [math.nan, 1.0, 2.0]), (94, [1.0, math.inf, 2.0]), (95, [1.0, 2.0])]
    twice = [(3, good[3][1]), (None, [0.5, 0.25, 7.0]), (None, [0.5, 0.25, 7.0])]
    found = whitening.whiten(table(spark, odd + good + twice)).collect()
    n, deviations, _, explained = brute([v for _, v in good + twice], 2)
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["deviation"]) for r in found) == sorted(
        (i is None, i or 0, d) for (i, _), d in zip(good + twice, deviations, strict=True)
    )
    assert all(r["n"] == n and len(r["whitened"]) == 2 and r["explained"] == pytest.approx(explained) for r in found)


def test_nothing_left(spark):
    assert whitening.by_component(whitening.whiten(table(spark, []))).collect() == []
    assert whitening.whiten(table(spark, [(1, None)])).collect() == []
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []


def test_blocks_meet_in_many_tasks(spark):
    """The product's cells are as many as its tasks, and each block goes to one of them."""
    rng = np.random.default_rng(3)
    data = rng.normal(size=(640, 4))
    blocks = spark.sparkContext.parallelize(
        [(b, whitening.DenseMatrix(10, 4, data[10 * b : 10 * b + 10].ravel(), True)) for b in range(64)], 4
    )
    assert np.allclose(whitening.scatter(blocks, 64, 4, 10, 9), data.T @ data)
    weights = rng.normal(size=(4, 3))
    made = dict(whitening.project(blocks, 64, weights, 10).collect())
    assert np.allclose(np.concatenate([np.frombuffer(made[b]).reshape(10, 3) for b in range(64)]), data @ weights)


def test_query(spark):
    rows = queries.QUERIES["op12_embedding_whitening"](spark, f"{DATA}/sf0.01").collect()
    stored = duckdb.sql(f"SELECT vec_id, embedding FROM '{DATA}/sf0.01/embeddings.parquet' ORDER BY vec_id").fetchall()
    compare(rows, [i for i, _ in stored], [v for _, v in stored])
