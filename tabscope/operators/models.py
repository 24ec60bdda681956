"""Logistic regression with balanced classes, its scores and its coefficients."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.operators.features import FeatureEncoder, feature_names
from tabscope.operators.joins import lookup_join
from tabscope.operators.newton import Problem, trust_region
from tabscope.operators.sums import vectors


@dataclass(frozen=True)
class LogisticModel:
    """An intercept and a coefficient per encoded feature: all of the model that the driver holds."""

    encoder: FeatureEncoder
    intercept: float
    coefficients: Sequence[float]


def balanced_weights(counts: Mapping[int, int]) -> dict[int, float]:
    """Weights n / (classes * class count); over all rows they add up to n."""
    total = sum(counts.values())
    return {level: total / (len(counts) * n) for level, n in counts.items()}


def logistic_fit(
    train: DataFrame,
    target: str,
    encoder: FeatureEncoder,
    penalize_intercept: bool = True,
    c: float = 1.0,
    max_iter: int = 1000,
    tolerance: float = 1e-6,
) -> LogisticModel:
    """L2 logistic regression, inverse strength ``c``, balanced class weights, by a trust-region Newton method.

    With ``penalize_intercept`` the bias is a coefficient like any other. The encoded rows are written once, as sparse
    vectors; each step scans only them, see ``trust_region``. It ends at a gradient of ``tolerance`` times that at zero.
    """
    classes = train.groupBy(target).agg(F.count("*").alias("n")).limit(3)
    counts = {row[target]: row["n"] for row in classes.collect()}
    if set(counts) != {0, 1}:
        raise ValueError(f"the target must hold both classes 0 and 1, found {sorted(counts, key=str)}")
    weights = balanced_weights(counts)
    label = F.col(target).cast("double")
    given = train.withColumns(
        {"__label": label, "__weight": F.when(label == 1.0, F.lit(weights[1])).otherwise(F.lit(weights[0]))}
    )
    rows = encoder.assemble(given, ["__label", "__weight"], "__features")
    rows = rows.select(F.col("__label").alias("label"), F.col("__weight").alias("weight"), "__features")
    data = vectors(rows, "__features", ["label", "weight"], "logistic", encoder.width)
    penalty = np.ones(data.width + 1)
    penalty[-1] = 1.0 if penalize_intercept else 0.0
    fit = trust_region(Problem(data, c, penalty), tolerance, max_iter)
    return LogisticModel(encoder, float(fit.weights[-1]), fit.weights[:-1])


def weight_table(spark: SparkSession, weights: Sequence[float], position: str, weight: str) -> DataFrame:
    """Coefficients with their positions as a table."""
    values = np.asarray(weights, np.float64)
    return spark.createDataFrame(pa.table({position: pa.array(np.arange(len(values))), weight: pa.array(values)}))


def logistic_score(df: DataFrame, model: LogisticModel, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns, the probability of class 1 and the predicted class; no Python per row.

    Numeric and 0/1 features enter as one expression; each category looks the coefficient of its level up in a table,
    made by a join of the level index with the coefficients: by broadcast within 64 MB, else by a shuffle that spreads hot
    levels.
    """
    encoder, spark = model.encoder, df.sparkSession
    margin = F.lit(float(model.intercept))
    for value, weight in zip(encoder.scaled().values(), model.coefficients):
        margin = margin + value * F.lit(float(weight))
    scored = df.withColumn("__margin", margin)
    for name, first in encoder.offsets().items():
        n = encoder.levels.sizes[name]
        if not n:
            continue
        weights = weight_table(spark, model.coefficients[first : first + n], "place", "__weight")
        known = encoder.levels.of(name).join(weights, "place").select(F.col("level").alias("__level"), "__weight")
        scored = scored.withColumn("__level", F.col(name).cast("string"))
        scored = lookup_join(scored, known, ["__level"], encoder.levels.bytes[name] + 8 * n)
        scored = scored.withColumn("__margin", F.col("__margin") + F.coalesce("__weight", F.lit(0.0)))
        scored = scored.drop("__weight", "__level")
    probability = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("__margin")))
    return scored.select(*keep, probability.alias("probability"), (F.col("__margin") > 0).cast("int").alias("prediction"))


def coefficient_table(spark: SparkSession, model: LogisticModel) -> DataFrame:
    """(variable, coefficient, abs_coefficient), largest magnitude first; one row per feature."""
    weights = weight_table(spark, model.coefficients, "position", "coefficient")
    table = feature_names(spark, model.encoder).join(weights, "position")
    columns = F.col("feature").alias("variable"), "coefficient", F.abs("coefficient").alias("abs_coefficient")
    return table.select(*columns).orderBy(F.col("abs_coefficient").desc(), "variable")


def top_coefficients(
    coefficients: DataFrame, n: int = 12, value: str = "coefficient", tie: str = "variable"
) -> DataFrame:
    """The ``n`` rows of largest magnitude, in ascending order of the signed value."""
    strongest = coefficients.orderBy(F.abs(F.col(value)).desc(), tie).limit(n)
    return strongest.orderBy(value, tie)
