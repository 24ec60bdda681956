"""Association between a categorical column and a 0/1 target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.functions.numbers import (
    ASSOCIATION_BANDS,
    STRONGEST_BAND,
    assumption_label,
    band_label,
    decision_label,
    percent,
    zero_or_one,
)
from tabscope.functions.stats import chi2_sf, cramers_v
from tabscope.operators.columns import require_columns

ALPHA = 0.05
SMALL_CELL = 5


def _observed(df: DataFrame, rows: str, target: str) -> DataFrame:
    """One row per level with the counts of both classes; rows missing either value are left out, other targets fail."""
    require_columns(df, [rows, target])
    known = df.where(F.col(rows).isNotNull() & F.col(target).isNotNull())
    value = zero_or_one(F.col(target), target)
    return known.groupBy(rows).agg(F.count_if(value == 0).alias("n_negative"), F.count_if(value == 1).alias("n_positive"))


def contingency_table(df: DataFrame, rows: str, target: str) -> DataFrame:
    """Counts of each level by class, sorted by level; an absent class counts 0."""
    return _observed(df, rows, target).orderBy(rows)


def contingency_percent(df: DataFrame, rows: str, target: str) -> DataFrame:
    """Row totals and row percentages."""
    total = F.col("n_negative") + F.col("n_positive")
    return contingency_table(df, rows, target).select(
        rows,
        total.alias("n_total"),
        "n_negative",
        "n_positive",
        percent(F.col("n_negative"), total).alias("pct_negative"),
        percent(F.col("n_positive"), total).alias("pct_positive"),
    )


def association_bars(df: DataFrame, rows: str, target: str) -> DataFrame:
    """Row percentages in ascending order of the positive share."""
    return contingency_percent(df, rows, target).orderBy("pct_positive", rows)


def _with_expected(df: DataFrame, rows: str, target: str) -> DataFrame:
    """Observed and expected counts per level, with the table margins on every row.

    The margins are a one-row scalar subquery over the same grouped counts, whose shuffle Spark reuses.
    """
    counts = _observed(df, rows, target)
    margins = counts.agg(
        F.struct(
            F.sum("n_negative").cast("double").alias("negative"),
            F.sum("n_positive").cast("double").alias("positive"),
            F.sum(F.col("n_negative") + F.col("n_positive")).alias("total"),
            F.count("*").alias("levels"),
        ).alias("margins")
    ).scalar()
    return (
        counts.withColumn("margins", margins)
        .withColumn("n_total", (F.col("n_negative") + F.col("n_positive")).cast("double"))
        .withColumn("expected_negative", F.col("n_total") * F.col("margins.negative") / F.col("margins.total"))
        .withColumn("expected_positive", F.col("n_total") * F.col("margins.positive") / F.col("margins.total"))
    )


def expected_frequencies(df: DataFrame, rows: str, target: str) -> DataFrame:
    """Row total x column total / total per cell, sorted by level."""
    return _with_expected(df, rows, target).select(rows, "expected_negative", "expected_positive").orderBy(rows)


def chi_square_test(
    df: DataFrame,
    rows: str,
    target: str,
    alpha: float = ALPHA,
    bands: Sequence[tuple[float, str]] = ASSOCIATION_BANDS,
    strongest: str = STRONGEST_BAND,
    decisions: tuple[str, str] = ("reject H0", "do not reject H0"),
    assumptions: tuple[str, str] = ("met", "interpret with caution"),
) -> DataFrame:
    """Chi-square test of independence as one row, with effect size and the check on small expected counts.

    The continuity correction applies to 2x2 tables only. A class that never occurs is not a column of the table.
    """
    # Both cells of a row miss their expectation by the same amount, so one gap serves the row.
    gap = F.abs(F.col("n_positive") - F.col("expected_positive"))
    weight = F.try_divide(F.lit(1.0), F.col("expected_negative")) + F.try_divide(F.lit(1.0), F.col("expected_positive"))
    corrected = gap - F.least(F.lit(0.5), gap)
    expected = F.array(
        F.when(F.col("margins.negative") > 0, F.col("expected_negative")),
        F.when(F.col("margins.positive") > 0, F.col("expected_positive")),
    )
    sums = (
        _with_expected(df, rows, target)
        .agg(
            F.coalesce(F.sum(gap * gap * weight), F.lit(0.0)).alias("plain"),
            F.coalesce(F.sum(corrected * corrected * weight), F.lit(0.0)).alias("continuity"),
            F.max("margins").alias("margins"),
            F.min(F.array_min(expected)).alias("min_expected"),
            F.sum(F.size(F.filter(expected, lambda e: e < SMALL_CELL))).alias("cells_below_5"),
        )
        .where(F.col("margins.levels") > 0)
    )
    classes = (F.col("margins.negative") > 0).cast("int") + (F.col("margins.positive") > 0).cast("int")
    tested = (
        sums.withColumn("classes", classes)
        .withColumn("dof", ((F.col("margins.levels") - 1) * (F.col("classes") - 1)).cast("int"))
        .withColumn("chi2", F.when(F.col("dof") == 1, F.col("continuity")).otherwise(F.col("plain")))
    )
    return (
        tested.withColumn("p_value", chi2_sf("chi2", "dof"))
        .withColumn(
            "cramers_v",
            cramers_v(F.col("chi2"), F.col("margins.total"), F.col("margins.levels"), F.col("classes")),
        )
        .select(
            F.lit("chi-square test of independence").alias("test"),
            F.lit(rows).alias("row_variable"),
            F.lit(target).alias("target"),
            F.lit(f"{target} is independent of {rows}").alias("null_hypothesis"),
            F.lit(f"{target} is associated with {rows}").alias("alternative_hypothesis"),
            "chi2",
            "p_value",
            "dof",
            F.lit(alpha).alias("alpha"),
            decision_label(F.col("p_value"), alpha, *decisions).alias("decision"),
            "cramers_v",
            band_label(F.col("cramers_v"), bands, strongest).alias("strength"),
            "min_expected",
            "cells_below_5",
            assumption_label(F.col("cells_below_5"), *assumptions).alias("assumption"),
        )
    )


def result_comments(result: DataFrame) -> DataFrame:
    """(aspect, comment) rows that put a test result into words."""
    aspects = F.array(
        F.struct(F.lit("normality").alias("aspect"), F.lit("not applicable to frequencies").alias("comment")),
        F.struct(
            F.lit("result").alias("aspect"),
            F.format_string("%s: %s", F.col("row_variable"), F.col("decision")).alias("comment"),
        ),
        F.struct(
            F.lit("effect_size").alias("aspect"),
            F.format_string("V = %.3f, %s", F.col("cramers_v"), F.col("strength")).alias("comment"),
        ),
    )
    return result.select(F.inline(aspects))
