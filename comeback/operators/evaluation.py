"""Evaluation of scored rows: ROC, AUC, confusion counts, threshold sweeps, reports.

Scored rows have ``label`` (0/1), ``probability`` and, where a class is needed, ``prediction``.
``by`` evaluates several models in the same pass; it names report-sized groups.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comeback.functions.scalars import round_half_even
from comeback.operators.ordered import running_totals

# Class names of the report and the swept thresholds.
CLASS_NAMES = ("Not Successful", "Successful")
SWEEP = tuple(float(t) for t in np.linspace(0.1, 0.9, 17))
SELECTED_THRESHOLDS = (0.2, 0.3, 0.4, 0.5, 0.6)


def _cumulative(scored: DataFrame, by: Sequence[str], rows: str | None = None) -> DataFrame:
    """Per distinct score: positives and negatives, their totals from the top and overall."""
    positive = F.col("label") == 1

    def total(test: Column) -> Column:
        return F.count_if(test) if rows is None else F.sum(F.when(test, F.col(rows)).otherwise(0))

    counts = scored.groupBy(*by, "probability").agg(total(positive).alias("pos"), total(~positive).alias("neg"))
    totals = counts.groupBy(*by).agg(
        F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"), F.max("probability").alias("top")
    )
    running = running_totals(counts, "probability", ["pos", "neg"], by, descending=True)
    return running.join(F.broadcast(totals), list(by)) if by else running.crossJoin(F.broadcast(totals))


def roc_points(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """False and true positive rate at each distinct score, from (0, 0) above the highest one."""
    curve = _cumulative(scored, by)

    def share(part: str, whole: str) -> Column:
        return F.col(part) / F.greatest(F.col(whole), F.lit(1))

    points = curve.select(
        *by,
        F.col("probability").alias("threshold"),
        share("cum_neg", "all_neg").alias("fpr"),
        share("cum_pos", "all_pos").alias("tpr"),
    )
    start = scored.groupBy(*by).agg((F.max("probability") + 1).alias("threshold"))
    return points.unionByName(start.withColumns({"fpr": F.lit(0.0), "tpr": F.lit(0.0)}))


def roc_auc(scored: DataFrame, by: Sequence[str] = (), rows: str | None = None) -> DataFrame:
    """Area under the ROC curve; rows with equal scores count half.

    Null when a class is missing. ``rows`` names a column that says how many rows a row stands for.
    """
    area = F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2)
    pairs = F.col("all_pos") * F.col("all_neg")
    total = F.sum(area) / F.when(F.max(pairs) > 0, F.max(pairs))
    return _cumulative(scored, by, rows).groupBy(*by).agg(total.alias("auc"))


def with_rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy from tp/fp/fn/tn, four decimals."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision = tp / F.greatest(tp + fp, F.lit(1))
    recall = tp / F.greatest(tp + fn, F.lit(1))
    f1 = 2 * precision * recall / F.greatest(precision + recall, F.lit(0.001))
    accuracy = (tp + tn) / F.greatest(tp + fp + fn + tn, F.lit(1))
    return counts.withColumns(
        {
            "precision": round_half_even(precision, 4),
            "recall": round_half_even(recall, 4),
            "f1": round_half_even(f1, 4),
            "accuracy": round_half_even(accuracy, 4),
        }
    )


def confusion(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    yes, hit = F.col("prediction") == 1, F.col("label") == 1
    return scored.groupBy(*by).agg(
        F.count_if(yes & hit).alias("tp"),
        F.count_if(yes & ~hit).alias("fp"),
        F.count_if(~yes & hit).alias("fn"),
        F.count_if(~yes & ~hit).alias("tn"),
    )


def precision_recall_f1(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return with_rates(confusion(scored, by))


def threshold_sweep(scored: DataFrame, thresholds: Sequence[float] = SWEEP) -> DataFrame:
    """Confusion counts and rates for ``probability >= threshold`` at every threshold.

    A row passes a prefix of the ascending thresholds, so one count per prefix length and label
    (a handful of rows) answers all thresholds.
    """
    ordered = sorted(thresholds)
    passed = sum(((F.col("probability") >= t).cast("int") for t in ordered), F.lit(0))
    groups = scored.groupBy(passed.alias("passed"), (F.col("label") == 1).alias("hit")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    steps = F.inline(
        F.array(
            *[
                F.struct(F.lit(i).alias("step"), F.lit(float(np.round(t, 2))).alias("threshold"))
                for i, t in enumerate(ordered, start=1)
            ]
        )
    )
    yes = F.col("passed") >= F.col("step")

    def rows(test: Column) -> Column:
        return F.sum(F.when(test, F.col("rows")).otherwise(0))

    counts = groups.select("passed", "hit", "rows", steps).groupBy("threshold").agg(
        rows(yes & F.col("hit")).alias("tp"),
        rows(yes & ~F.col("hit")).alias("fp"),
        rows(~yes & F.col("hit")).alias("fn"),
        rows(~yes & ~F.col("hit")).alias("tn"),
    )
    return with_rates(counts).orderBy("threshold")


def selected_thresholds(sweep: DataFrame, wanted: Sequence[float] = SELECTED_THRESHOLDS) -> DataFrame:
    return sweep.filter(F.col("threshold").isin(*wanted))


def classification_report(scored: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted averages."""
    counts = confusion(scored)

    def per_class(name: str, right: str, wrong: str, missed: str) -> Column:
        precision = F.col(right) / F.greatest(F.col(right) + F.col(wrong), F.lit(1))
        recall = F.col(right) / F.greatest(F.col(right) + F.col(missed), F.lit(1))
        f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
        return F.struct(
            F.lit(name).alias("class"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            (F.col(right) + F.col(missed)).alias("support"),
        )

    classes = counts.select(
        F.inline(F.array(per_class(CLASS_NAMES[0], "tn", "fn", "fp"), per_class(CLASS_NAMES[1], "tp", "fp", "fn")))
    )
    rates = ("precision", "recall", "f1")
    support = F.sum("support")
    macro = classes.agg(*[F.avg(c).alias(c) for c in rates], support.alias("support"))
    weighted = classes.agg(
        *[(F.sum(F.col(c) * F.col("support")) / support).alias(c) for c in rates], support.alias("support")
    )
    rows = classes.unionByName(macro.withColumn("class", F.lit("macro avg"))).unionByName(
        weighted.withColumn("class", F.lit("weighted avg"))
    )
    return rows.select("class", *[round_half_even(F.col(c), 4).alias(c) for c in rates], "support")


def best_model(results: DataFrame) -> DataFrame:
    """The model with the highest AUC, the first name on ties."""
    return results.orderBy(F.desc("auc"), "model").limit(1)
