"""Whitening of embeddings with MLlib's block matrices.

Entries become whole numbers first, so sums and deviations are exact under any partitioning. Centred
vectors are indexed into blocks of ``block_rows`` rows; the blocks' transposes are multiplied with the
blocks for the scatter matrix, whose eigenvectors are found on the driver (d x d numbers); block
products with the whitening matrix project the rows.

A block matrix deals the blocks of a product to tasks by their place in it. A tall matrix of one
block column would give d x d or d x 32 products to a few tasks, so blocks are laid out on a square:
the left blocks of the scatter have row labels, the right ones column labels, and each cell of the
product is the scatter of the blocks that share both; the cells' sum is the scatter of all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comeback.llm.common import staged


@dataclass(frozen=True)
class Whitening:
    """``components``: most components told. ``scale``, ``shift``: entry c becomes floor(scale * c) + shift.
    ``block_rows``: rows of a block. ``task_rows``: rows of the blocks that one task multiplies. ``least``:
    part of the trace an eigenvalue must have; what is less is rounding, not a direction."""

    components: int = 32
    scale: int = 64
    shift: int = 1_000_000
    block_rows: int = 1024
    task_rows: int = 1 << 14
    least: float = 1e-13


def whole_vectors(frame: DataFrame, rule: Whitening, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, x): the rows whose vector has only finite entries, as whole numbers."""
    vector = frame[vector_column].cast("array<double>")

    def finite(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(math.inf))

    rows = frame.select(frame[id_column].alias("vec_id"), vector.alias("vector"))
    rows = rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", finite))
    whole = F.transform("vector", lambda c: F.floor(c * rule.scale).cast("bigint") + F.lit(rule.shift).cast("bigint"))
    return rows.select("vec_id", whole.alias("x"))


def column_sums(rows: DataFrame, column: str, kind: str) -> list:
    """Sum of each place of an array column, added up in tasks first."""
    element = pa.int64() if kind == "bigint" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                values = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1)
                total = values.sum(axis=0) + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total, element)], names=["at", "total"])

    sums = rows.select(column).mapInArrow(run, f"at int, total {kind}").groupBy("at").agg(F.sum("total").alias("total"))
    return [r["total"] for r in sums.orderBy("at").collect()]


def _blocks(rows: DataFrame, mean: np.ndarray, rule: Whitening, parts: int) -> DataFrame:
    """(part, chunk, ids, deviations, data): centred rows, ``block_rows`` to a block, the last of a task
    filled up with zero rows, which add nothing to a scatter."""
    size, width = rule.block_rows, len(mean)
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        chunk = 0

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, chunk
            table = pa.Table.from_batches(held).combine_chunks()
            while table.num_rows >= size or (last and table.num_rows):
                piece, table = table.slice(0, size), table.slice(size)
                x = np.asarray(piece.column(1).combine_chunks().flatten()).reshape(-1, width)
                data = np.zeros((size, width))
                data[: len(x)] = x - mean
                ids, deviations = (pa.array([piece.column(i).to_pylist()], pa.list_(piece.schema.field(i).type)) for i in (0, 2))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), ids, deviations, pa.array([data.tobytes()], pa.binary())],
                    names=["part", "chunk", "ids", "deviations", "data"],
                )
                chunk += 1
            held = table.to_batches()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= size:
                yield from cut(False)
        if held:
            yield from cut(True)

    schema = f"part int, chunk int, ids array<{kind}>, deviations array<bigint>, data binary"
    return rows.repartition(parts).select("vec_id", "x", "deviation").mapInArrow(run, schema)


def _indexed(blocks: DataFrame) -> tuple[DataFrame, int]:
    """The stored blocks with ``block``, numbered from 0 without gaps, and how many there are.

    What reaches the driver is one count per task that wrote blocks.
    """
    counts = blocks.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    starts, total = [], 0
    for row in counts:
        starts.append((row["part"], total))
        total += row["n"]
    places = blocks.sparkSession.createDataFrame(starts, "part int, first bigint")
    return blocks.join(F.broadcast(places), "part").withColumn("block", F.col("first") + F.col("chunk")), total


def _numbered(blocks: DataFrame, width: int, size: int) -> RDD:
    """(block, matrix) of each stored block."""

    def matrix(row) -> tuple[int, DenseMatrix]:
        return row["block"], DenseMatrix(size, width, np.frombuffer(row["data"], np.float64), True)

    return blocks.select("block", "data").rdd.map(matrix)


def scatter(matrices: RDD, count: int, width: int, size: int, parts: int) -> np.ndarray:
    """Sum over all blocks of transpose times block, by one product of block matrices.

    Block b is at row label b mod s on the left and column label (b div s) mod s on the right, so the
    s x s products go to as many tasks, and every block to one.
    """
    side = max(1, math.ceil(math.sqrt(min(parts, count))))
    left = matrices.map(lambda m: ((m[0], m[0] % side), m[1]))
    right = matrices.map(lambda m: ((m[0], m[0] // side % side), m[1]))
    shape = size, width, count * size, side * width
    tall = BlockMatrix(left.repartition(side * side) if left.getNumPartitions() < side * side else left, *shape)
    product = tall.transpose().multiply(BlockMatrix(right, *shape))
    cells = product.blocks.map(lambda cell: cell[1].toArray())
    return cells.treeAggregate(np.zeros((width, width)), lambda a, b: a + b, lambda a, b: a + b)


def project(matrices: RDD, count: int, weights: np.ndarray, size: int) -> RDD:
    """(block, block times ``weights`` as row-major bytes), by one product of block matrices.

    Blocks fill a square of s x s; the right matrix has ``weights`` s times on its diagonal.
    """
    side = max(1, math.ceil(math.sqrt(count)))
    width, components = weights.shape
    values = weights.ravel(order="F")
    context = matrices.context
    placed = matrices.map(lambda m: ((m[0] % side, m[0] // side), m[1]))
    diagonal = context.parallelize(range(side), min(side, 64)).map(lambda i: ((i, i), DenseMatrix(width, components, values)))
    square = BlockMatrix(placed, size, width, side * size, side * width)
    product = square.multiply(BlockMatrix(diagonal, width, components, side * width, side * components))
    return product.blocks.map(lambda b: (b[0][0] + b[0][1] * side, b[1].toArray().tobytes())).filter(lambda b: b[0] < count)


def whiten(
    frame: DataFrame, rule: Whitening | None = None, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """One row per remaining row of ``frame``: vec_id, n, deviation, ``whitened`` (array, a number per
    component by falling eigenvalue), ``explained`` (array, the eigenvalues over the trace) and
    identity_error (largest entry of the whitened rows' covariance minus the identity).

    Rows whose vector is null, empty, or holds null or non-finite entries are left out, and so are
    vectors of another length than most have (of equally frequent lengths the longest counts). Repeated
    rows and rows without an id are kept each. A direction without variance has no component; if no
    direction has any, or no row remains, no rows come back. Other columns are not looked at.
    ``deviation`` is exact; beyond 64 bits it is an error. The driver holds matrices of d x d.
    """
    rule = rule or Whitening()
    spark = frame.sparkSession
    valid = whole_vectors(frame, rule, id_column, vector_column)
    kind = valid.schema["vec_id"].dataType.simpleString()
    empty = spark.createDataFrame(
        [], f"vec_id {kind}, n bigint, deviation bigint, whitened array<double>, explained array<double>, identity_error double"
    )
    lengths = valid.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    top = lengths.orderBy(F.desc("n"), F.desc("width")).first()
    if top is None:
        return empty
    width, n = top["width"], top["n"]
    rows = valid.where(F.size("x") == width)
    sums = column_sums(rows, "x", "bigint")
    mean = np.array(sums, np.float64) / n
    whole = F.lit(n).cast("bigint")
    far = F.zip_with("x", F.array(*[F.lit(s).cast("bigint") for s in sums]), lambda x, s: (whole * x - s) * (whole * x - s))
    rows = rows.withColumn("deviation", F.aggregate(far, F.lit(0).cast("bigint"), lambda a, v: a + v))

    size, parts = rule.block_rows, max(1, math.ceil(n / rule.task_rows))
    blocks, count = _indexed(staged(_blocks(rows, mean, rule, parts), "blocks"))
    matrices = _numbered(blocks, width, size)
    covariance = scatter(matrices, count, width, size, parts) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[: rule.components]
    order = order[values[order] > rule.least * max(np.trace(covariance), 1e-300)]
    if not len(order):
        return empty
    values, vectors = values[order], vectors[:, order]
    explained = [float(v) for v in values / np.trace(covariance)]

    projected = project(matrices, count, vectors / np.sqrt(values), size)
    white = staged(spark.createDataFrame(projected, "block bigint, data binary"), "whitened")
    k = len(values)
    # Filled-up rows were zero and stay zero; means over the n rows are sums over the blocks.
    centre = np.array(column_sums(_rows_of(blocks.select("block", F.size("ids").alias("size")), white, k, False), "whitened", "double")) / n
    second = scatter(_numbered(white, k, size), count, k, size, parts) / n - np.outer(centre, centre)
    error = float(np.abs(second - np.eye(k)).max())

    listed = blocks.select("block", "ids", "deviations", F.size("ids").alias("size"))
    found = _rows_of(listed, white, k, True, kind)
    return found.select(
        "vec_id",
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.array(*map(F.lit, explained)).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def _rows_of(blocks: DataFrame, white: DataFrame, k: int, named: bool, kind: str = "bigint") -> DataFrame:
    """Blocks cut into rows again, with ids and deviations if ``named``."""
    joined = blocks.join(white, "block")
    order = ["size", "data", *(["ids", "deviations"] if named else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                size = batch.column(0)[i].as_py()
                values = np.frombuffer(batch.column(1)[i].as_py(), np.float64)[: size * k]
                lists = pa.ListArray.from_arrays(pa.array(range(0, size * k + 1, k), pa.int32()), pa.array(values))
                ids = [batch.column(c)[i].values for c in (2, 3)] if named else []
                yield pa.RecordBatch.from_arrays([*ids, lists], names=[*(["vec_id", "deviation"] if named else []), "whitened"])

    names = f"vec_id {kind}, deviation bigint, " if named else ""
    return joined.select(*order).mapInArrow(run, f"{names}whitened array<double>")


def by_component(whitened: DataFrame) -> DataFrame:
    """A row per row and component, numbered from 1."""
    pairs = F.arrays_zip("whitened", "explained")
    rows = whitened.select("vec_id", "n", "deviation", "identity_error", F.posexplode(pairs).alias("at", "pair"))
    return rows.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        "n",
        "deviation",
        F.col("pair.whitened").alias("whitened"),
        F.col("pair.explained").alias("explained"),
        "identity_error",
    )
