"""Evaluation of 0/1 predictions and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscope.functions.numbers import zero_or_one
from tabscope.operators.profile import stack_row


def _cells(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """The four confusion counts in one row."""
    real, said = zero_or_one(F.col(label), label), zero_or_one(F.col(prediction), prediction)
    return df.agg(
        F.count_if((real == 0) & (said == 0)).alias("tn"),
        F.count_if((real == 0) & (said == 1)).alias("fp"),
        F.count_if((real == 1) & (said == 0)).alias("fn"),
        F.count_if((real == 1) & (said == 1)).alias("tp"),
    )


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """2x2 counts, real classes 0 and 1 as rows; classes that do not occur count 0."""
    entries = [(F.lit(0), F.col("tn"), F.col("fp")), (F.lit(1), F.col("fn"), F.col("tp"))]
    return stack_row(_cells(df, label, prediction), entries, ("real", "predicted_0", "predicted_1"))


def confusion_shares(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Every cell with its share of the largest cell (at least 1)."""
    largest = F.greatest("tn", "fp", "fn", "tp", F.lit(1)).cast("double")
    entries = [
        (F.lit(real), F.lit(said), F.col(cell), F.col(cell).cast("double") / largest)
        for cell, real, said in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
    ]
    return stack_row(_cells(df, label, prediction), entries, ("real", "predicted", "n", "share"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def classification_metrics(df: DataFrame, label: str, prediction: str, score: str | None = None) -> DataFrame:
    """Accuracy and macro precision, recall and F1, one row per metric; ``roc_auc`` too when ``score`` is given.

    Macro values are means over the classes that occur as real or predicted value; 0 stands for a zero division.
    """
    tn, fp, fn, tp = (F.col(cell) for cell in ("tn", "fp", "fn", "tp"))
    per_class = {
        "precision_macro": (_ratio(tn, tn + fn), _ratio(tp, tp + fp)),
        "recall_macro": (_ratio(tn, tn + fp), _ratio(tp, tp + fn)),
        "f1_macro": (_ratio(2 * tn, 2 * tn + fn + fp), _ratio(2 * tp, 2 * tp + fn + fp)),
    }
    seen_0, seen_1 = ((tn + fp + fn) > 0).cast("double"), ((tp + fp + fn) > 0).cast("double")
    entries = [(F.lit("accuracy"), _ratio(tn + tp, tn + fp + fn + tp))]
    for name, (zero, one) in per_class.items():
        entries.append((F.lit(name), _ratio(zero * seen_0 + one * seen_1, seen_0 + seen_1)))
    metrics = stack_row(_cells(df, label, prediction), entries, ("metric", "value"))
    if score is None:
        return metrics
    return metrics.unionByName(roc_auc(df, label, score).select(F.lit("roc_auc").alias("metric"), "value"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact area under the ROC curve: the share of (positive, negative) pairs in the right order, ties half.

    Equal scores are counted first, so a frequent score is one row. The distinct scores are range-partitioned; pairs
    inside a partition come from running counts, pairs across partitions from the partition totals, one small row
    each. No task sees all scores. NULL where a class is absent.
    """
    real = zero_or_one(F.col(label), label)
    positive, negative = F.count_if(real == 1), F.count_if(real == 0)
    per_score = (
        df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(positive.cast("double").alias("pos"), negative.cast("double").alias("neg"))
    )
    ranged = per_score.repartitionByRange("score").withColumn("range", F.spark_partition_id())
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(before.partitionBy("range").orderBy("score")), F.lit(0.0))
    per_range = (
        ranged.withColumn("below", below)
        .groupBy("range")
        .agg(
            F.sum("pos").alias("pos"),
            F.sum("neg").alias("neg"),
            F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).alias("pairs"),
        )
    )
    # One row per range from here on.
    lower = F.coalesce(F.sum("neg").over(before.orderBy("range")), F.lit(0.0))
    pairs = per_range.withColumn("pairs", F.col("pairs") + F.col("pos") * lower)
    return pairs.agg(F.try_divide(F.sum("pairs"), F.sum("pos") * F.sum("neg")).alias("value"))
