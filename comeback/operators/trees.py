"""Forests as tables of nodes: votes and attribution for trees of any shape.

A node table has one row per node: tree, node (0 is the root), feature (its number; -1 at a leaf),
threshold (at or below it goes left), left, right, prediction (0 or 1 at a leaf) and cover (training
rows, or their weight, at the node). It is as large as the model, never as the data.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from comeback.sources.storage import remove_folder, shared_folder

SCHEMA = (
    "tree int, node int, feature int, threshold double, left int, right int, prediction double, cover double"
)
INTERVAL = "array<struct<feature:int,slot:int,low:double,high:double>>"
_fetched: WeakKeyDictionary[RandomForestClassificationModel, pa.Table] = WeakKeyDictionary()
#: Rows that walk a tree at once when features are exchanged.
WALKED_ROWS = 2048
#: Features on one path that attribution takes; a path of m features has 2^m cases.
MOST_FEATURES = 12


def saved_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Node table of a saved random forest, from its Parquet files."""
    data = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    leaf = F.col("leftChild") < 0
    return data.select(
        F.col("treeID").cast("int").alias("tree"),
        F.col("id").cast("int").alias("node"),
        F.when(leaf, -1).otherwise(F.col("split.featureIndex")).cast("int").alias("feature"),
        F.when(leaf, 0.0).otherwise(F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.when(leaf, -1).otherwise(F.col("leftChild")).cast("int").alias("left"),
        F.when(leaf, -1).otherwise(F.col("rightChild")).cast("int").alias("right"),
        F.when(leaf, F.col("prediction")).otherwise(0.0).alias("prediction"),
        F.col("rawCount").cast("double").alias("cover"),
    )


def model_nodes(spark: SparkSession, model: RandomForestClassificationModel) -> DataFrame:
    """Node table of a fitted random forest, by saving it to the shared folder and reading it back."""
    return spark.createDataFrame(fetched_nodes(spark, model), SCHEMA)


def fetched_nodes(spark: SparkSession, model: RandomForestClassificationModel) -> pa.Table:
    """The same in the driver's memory, saved and read once for as long as the model is in use."""
    if model not in _fetched:
        path = f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}"
        model.write().save(path)
        try:
            _fetched[model] = saved_nodes(spark, path).toArrow()
        finally:
            remove_folder(spark, path)
    return _fetched[model]


def flat_forest(nodes: DataFrame) -> DataFrame:
    """One row with the whole forest as arrays: nodes of all trees in a row, children as places in it.

    A leaf is its own child, so a walk may go on there.
    """
    order = Window.orderBy("tree", "node")
    placed = nodes.withColumn("at", F.row_number().over(order) - 1)
    base = F.col("at") - F.col("node")
    leaf = F.col("left") < 0
    entry = F.struct(
        "at",
        "feature",
        "threshold",
        F.when(leaf, F.col("at")).otherwise(base + F.col("left")).alias("left"),
        F.when(leaf, F.col("at")).otherwise(base + F.col("right")).alias("right"),
        "prediction",
        F.col("node"),
    )
    listed = placed.agg(F.array_sort(F.collect_list(entry)).alias("n"))
    return listed.select(
        *[F.col(f"n.{c}").alias(f"_{c}") for c in ("feature", "threshold", "left", "right", "prediction")],
        F.transform(F.filter("n", lambda n: n["node"] == 0), lambda n: n["at"]).alias("_roots"),
    )


def tree_votes(frame: DataFrame, values: Column, nodes: DataFrame, depth: int) -> DataFrame:
    """Add ``probability``, the share of trees that predict 1, and ``prediction``; a tie is class 0.

    Every tree is walked ``depth`` steps (no tree is deeper) inside a projection; the forest is
    broadcast as one row, and rows are not moved. A null or missing value goes right.
    """
    forest = F.broadcast(flat_forest(nodes))
    walked = frame.withColumn("_values", values).crossJoin(forest)

    def step(at: Column, _: Column) -> Column:
        goes_left = F.get("_values", F.get("_feature", at)) <= F.get("_threshold", at)
        return F.when(goes_left, F.get("_left", at)).otherwise(F.get("_right", at))

    def leaf(root: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), root, step) if depth else root

    ones = F.aggregate("_roots", F.lit(0.0), lambda votes, root: votes + F.get("_prediction", leaf(root)))
    share = ones / F.greatest(F.size("_roots"), F.lit(1))
    scored = walked.select(*frame.columns, share.alias("probability"))
    return scored.withColumn("prediction", (F.col("probability") > 0.5).cast("int"))


def packed_trees(nodes: pa.Table) -> list[tuple[np.ndarray, ...]]:
    """Of every tree the feature, threshold, left and right child and prediction of its nodes, by their number.

    A leaf is its own child.
    """
    nodes = nodes.sort_by([("tree", "ascending"), ("node", "ascending")])
    tree, node, feature, threshold, left, right, prediction = (
        nodes.column(c).to_numpy() for c in ("tree", "node", "feature", "threshold", "left", "right", "prediction")
    )
    leaf = left < 0
    left, right = np.where(leaf, node, left), np.where(leaf, node, right)
    bounds = [0, *(np.flatnonzero(np.diff(tree)) + 1), len(tree)]
    sides = (feature, threshold, left, right, prediction.astype(np.int64))
    return [tuple(np.ascontiguousarray(side[i:j]) for side in sides) for i, j in zip(bounds, bounds[1:]) if j > i]


def exchanged_counts(rows: DataFrame, features: int, nodes: pa.Table, depth: int) -> DataFrame:
    """(feature, probability, label, rows): how many rows get which share of trees that predict 1, with
    nothing exchanged (feature -1) and with each feature's value exchanged alone.

    ``rows`` has ``label``, ``values`` and ``donor``, the values to take, both arrays without nulls. A
    tree is walked once by a row's own values, and again only from the first node of its path at
    which the exchanged value goes to the other side: where there is none, the leaf is the same.
    """
    kind = rows.schema["label"].dataType
    forest = packed_trees(nodes)
    most = len(forest)

    def votes(own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Trees that predict 1 for each row, and for each row and feature by the exchanged value."""
        count = len(own)
        here, base, changes = np.arange(count), np.zeros(count, np.int64), np.zeros((count, features), np.int64)
        for feature, threshold, left, right, prediction in forest:
            at, met = np.zeros(count, np.int32), np.zeros((count, features), bool)
            again: list[tuple[np.ndarray, ...]] = []
            for _ in range(depth):
                f, limit = feature[at], threshold[at]
                goes = own[here, f] <= limit
                turns = np.flatnonzero((goes != (other[here, f] <= limit)) & (f >= 0) & ~met[here, f])
                if len(turns):
                    met[turns, f[turns]] = True
                    again.append((turns, f[turns], np.where(goes[turns], right[at[turns]], left[at[turns]])))
                at = np.where(goes, left[at], right[at])
            leaf = prediction[at]
            base += leaf
            if again:
                row, taken, start = (np.concatenate(part) for part in zip(*again))
                for _ in range(depth - 1):
                    f = feature[start]
                    value = np.where(f == taken, other[row, f], own[row, f])
                    start = np.where(value <= threshold[start], left[start], right[start])
                changes[row, taken] += prediction[start] - leaf[row]
        return base, base[:, None] + changes

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, WALKED_ROWS):
                batch = whole.slice(at, WALKED_ROWS)
                label = batch.column("label").dictionary_encode(null_encoding="encode")
                code, names = label.indices.to_numpy(zero_copy_only=False).astype(np.int64), label.dictionary
                base, each = votes(matrix(batch.column("values")), matrix(batch.column("donor")))
                for feature in range(-1, features):
                    found = base if feature < 0 else each[:, feature]
                    counts = np.bincount(code * (most + 1) + found, minlength=len(names) * (most + 1))
                    slots = np.flatnonzero(counts)
                    share = (slots % (most + 1)) / np.float64(max(most, 1))
                    columns = [np.full(len(slots), feature, np.int32), share, names.take(pa.array(slots // (most + 1))), counts[slots]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=shape)

    shape = pa.schema([("feature", pa.int32()), ("probability", pa.float64()), ("label", to_arrow_type(kind)), ("rows", pa.int64())])
    counted = rows.select("label", "values", "donor").mapInArrow(run, f"feature int, probability double, label {kind.simpleString()}, rows bigint")
    return counted.groupBy("feature", "probability", "label").agg(F.sum("rows").alias("rows"))


@dataclass(frozen=True)
class Path:
    """A leaf and what leads to it: per feature the interval (low, high] and the part of the rows that a
    coin weighted by cover lets through."""

    features: tuple[int, ...]
    lows: tuple[float, ...]
    highs: tuple[float, ...]
    parts: tuple[float, ...]
    value: float

    def attributions(self) -> list[list[float]]:
        """For every set of features whose interval holds (as bits), what each feature adds.

        The Shapley value of a product of factors: in each order the features are revealed in, a known
        feature's factor is 1 or 0, an unknown one's its part.
        """
        m = len(self.features)
        out = []
        for mask in range(1 << m):
            holds = [float(mask >> i & 1) for i in range(m)]
            row = []
            for i in range(m):
                others = [j for j in range(m) if j != i]
                total = 0.0
                for size in range(m):
                    weight = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
                    for known in combinations(others, size):
                        total += weight * math.prod(holds[j] if j in known else self.parts[j] for j in others)
                row.append(self.value * (holds[i] - self.parts[i]) * total)
            out.append(row)
        return out


def paths(nodes: Sequence) -> list[Path]:
    """Every path to a leaf that predicts something, from the collected rows of a node table."""
    known = {(n["tree"], n["node"]): n for n in nodes}
    found = []
    for root in (n for n in nodes if n["node"] == 0):
        open_ = [(root, {})]
        while open_:
            node, limits = open_.pop()
            if node["left"] < 0:
                if node["prediction"]:
                    if len(limits) > MOST_FEATURES:
                        raise ValueError(f"a path of {len(limits)} features has too many cases")
                    order = sorted(limits)
                    sides = [tuple(limits[f][i] for f in order) for i in range(3)]
                    found.append(Path(tuple(order), *sides, node["prediction"]))
                continue
            for child, left in ((node["left"], True), (node["right"], False)):
                child = known[node["tree"], child]
                low, high, part = limits.get(node["feature"], (-math.inf, math.inf, 1.0))
                low, high = (low, min(high, node["threshold"])) if left else (max(low, node["threshold"]), high)
                share = child["cover"] / node["cover"] if node["cover"] else 0.5
                open_.append((child, limits | {node["feature"]: (low, high, part * share)}))
    return found


def attribution(
    frame: DataFrame, columns: Sequence[str], nodes: DataFrame, key: str = "person_id"
) -> tuple[DataFrame, float]:
    """(key, feature, contribution) of every row of ``frame`` and every feature the forest splits on, and
    the base value.

    Contributions are exact Shapley values of the vote share: with the base they sum to the row's
    share. A feature left unknown is decided by the training rows' parts at its splits. Paths may
    hold ``MOST_FEATURES`` different features. A row's terms are added up where the row is.
    """
    spark = frame.sparkSession
    rows = nodes.collect()
    trees = len({r["tree"] for r in rows})
    leaves = paths(rows)
    base = math.fsum(p.value * math.prod(p.parts) for p in leaves) / max(1, trees)
    table = [
        (
            [(f, i, low, high) for i, (f, low, high) in enumerate(zip(p.features, p.lows, p.highs, strict=True))],
            [[a / trees for a in case] for case in p.attributions()],
        )
        for p in leaves
        if p.features
    ]
    schema = f"conditions {INTERVAL}, cases array<array<double>>"
    forest = spark.createDataFrame(table, schema).agg(F.collect_list(F.struct("conditions", "cases")).alias("_leaves"))
    values = F.array(*[F.col(c).cast("double") for c in columns])
    each = frame.select(key, values.alias("_values")).crossJoin(F.broadcast(forest)).select(key, "_values", F.inline("_leaves"))

    def bit(mask: Column, c: Column) -> Column:
        value = F.get("_values", c["feature"])
        inside = (value > c["low"]) & (value <= c["high"])
        return mask + F.when(inside, F.pow(F.lit(2.0), c["slot"]).cast("int")).otherwise(0)

    case = F.get("cases", F.aggregate("conditions", F.lit(0), bit))
    terms = each.select(key, F.inline(F.arrays_zip(F.col("conditions.feature").alias("feature"), case.alias("amount"))))
    sums = terms.groupBy(key, "feature").agg(F.sum("amount").alias("contribution"))
    names = F.array(*map(F.lit, columns))
    return sums.select(key, F.get(names, F.col("feature")).alias("feature"), "contribution"), base
