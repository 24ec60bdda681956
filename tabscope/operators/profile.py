"""Column profiles: missing and distinct counts, duplicates, IQR limits, histograms, box statistics."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegralType, MapType, StringType, StructType

from tabscope.functions.numbers import min_max_scale, percent
from tabscope.functions.text import key_digest
from tabscope.operators.columns import observed_value, require_columns, value_of
from tabscope.operators.order_stats import ColumnSummary, summarize_columns

QUARTILES = (0.25, 0.5, 0.75)
FENCE = 1.5


def stack_row(row: DataFrame, entries: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """Turn a one-row table into one row per entry, with columns ``names``."""
    structs = [F.struct(*[value.alias(name) for value, name in zip(entry, names)]) for entry in entries]
    return row.select(F.inline(F.array(*structs)))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: rows, missing values and number of columns of the table, from one scan."""
    columns = list(columns or df.columns)
    require_columns(df, columns)
    counts = df.agg(
        F.count("*").alias("__rows"),
        *[F.count_if(value_of(df, name).isNull()).alias(f"__missing{i}") for i, name in enumerate(columns)],
    )
    entries = [
        (F.lit(name), F.col("__rows"), F.col(f"__missing{i}"), F.lit(len(df.columns)))
        for i, name in enumerate(columns)
    ]
    return stack_row(counts, entries, ("variable", "n_rows", "n_missing", "n_columns"))


def plain_value(df: DataFrame, name: str) -> Column:
    """A column in which equal values are one value: NaN is missing, zero has no sign."""
    kind = df.schema[name].dataType
    if isinstance(kind, (DoubleType, FloatType)):
        return value_of(df, name) + F.lit(0.0).cast(kind)
    return F.col(f"`{name}`")


def levels_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, value) pairs of the present values of several columns, as text."""
    texts = df.select(*[plain_value(df, name).cast("string").alias(name) for name in columns])
    return texts.unpivot([], list(columns), "variable", "value").where(F.col("value").isNotNull())


def distinct_profile(df: DataFrame, columns: Sequence[str], relative_error: float | None = None) -> DataFrame:
    """Distinct present values per column: exact, or sketched when ``relative_error`` is given."""
    require_columns(df, columns)
    if relative_error is not None:
        counts = df.agg(*[F.approx_count_distinct(value_of(df, name), relative_error).alias(name) for name in columns])
        return stack_row(counts, [(F.lit(name), F.col(f"`{name}`")) for name in columns], ("variable", "n_distinct"))
    names = df.sparkSession.createDataFrame([(name,) for name in columns], "variable string")
    levels = levels_long(df, columns).withColumn("value", key_digest(F.col("value")))
    counted = levels.groupBy("variable").agg(F.count_distinct("value").alias("n_distinct"))
    return names.join(F.broadcast(counted), "variable", "left").select(
        "variable", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct")
    )


def sorted_levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sorted distinct present levels of each categorical, one row per level."""
    require_columns(df, columns)
    return levels_long(df, columns).distinct().orderBy("variable", "value")


def duplicate_count(df: DataFrame, keys: Sequence[str] | None = None, name: str = "n_duplicates") -> DataFrame:
    """Extra copies of a whole row, or of ``keys``; missing values are equal to each other.

    Copies are counted map-side first and long texts travel as digests, so neither a value copied onto a third
    of the rows nor whole documents burden the shuffle.
    """
    keys = list(keys or df.columns)
    require_columns(df, keys)
    types = {field.name: field.dataType for field in df.schema}
    group = []
    for key in keys:
        column = F.col(f"`{key}`")
        if isinstance(types[key], (MapType, StructType, ArrayType)):
            column = key_digest(F.to_json(F.struct(column)))
        elif isinstance(types[key], StringType):
            column = key_digest(column)
        group.append(column.alias(key))
    copies = df.select(*group).groupBy(*[F.col(f"`{key}`") for key in keys]).agg(F.count("*").alias("__copies"))
    return copies.agg(F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).alias(name))


# -- distributions -----------------------------------------------------------------------------------------------


def observed_columns(df: DataFrame, variables: Sequence[str], suffix: str = "_imputed") -> DataFrame:
    """The variables as doubles, with imputed rows blanked out."""
    require_columns(df, variables)
    return df.select(*[observed_value(df, name, suffix).cast("double").alias(name) for name in variables])


def _limits(summary: ColumnSummary) -> tuple[float | None, float | None, float | None]:
    """IQR, lower and upper limit."""
    q1, q3 = summary.quantiles[0.25], summary.quantiles[0.75]
    if q1 is None or q3 is None:
        return None, None, None
    iqr = q3 - q1
    return iqr, q1 - FENCE * iqr, q3 + FENCE * iqr


def outside(value: Column, low: float | None, high: float | None) -> Column:
    if low is None or high is None:
        return F.lit(False)
    return (value < F.lit(low)) | (value > F.lit(high))


IQR_SCHEMA = (
    "variable string, n long, minimum double, q1 double, median double, q3 double, maximum double, "
    "iqr double, lower_limit double, upper_limit double"
)


def _summary_rows(summaries: Mapping[str, ColumnSummary]) -> list[tuple]:
    rows = []
    for name, summary in summaries.items():
        iqr, low, high = _limits(summary)
        q1, median, q3 = (summary.quantiles[p] for p in QUARTILES)
        rows.append((name, summary.n, summary.minimum, q1, median, q3, summary.maximum, iqr, low, high))
    return rows


def _with_outlier_counts(observed: DataFrame, summaries: Mapping[str, ColumnSummary]) -> DataFrame:
    """The summary table with outlier counts taken by one scan over the observed columns."""
    counts = observed.agg(
        *[
            F.count_if(outside(F.col(f"`{name}`"), *_limits(summary)[1:])).alias(f"__outliers{i}")
            for i, (name, summary) in enumerate(summaries.items())
        ]
    )
    entries = []
    for i, row in enumerate(_summary_rows(summaries)):
        numbers = [F.lit(value).cast("double") for value in row[2:]]
        outliers = F.col(f"__outliers{i}")
        total = F.lit(row[1]).cast("long")
        entries.append([F.lit(row[0]), total, *numbers, outliers, percent(outliers, total)])
    names = [part.split()[0] for part in IQR_SCHEMA.split(", ")] + ["n_outliers", "pct_outliers"]
    return stack_row(counts, entries, names)


def iqr_summary(
    df: DataFrame,
    variables: Sequence[str],
    suffix: str = "_imputed",
    summaries: Mapping[str, ColumnSummary] | None = None,
) -> DataFrame:
    """Per variable: count, five numbers, IQR, limits and outliers of the observed (not imputed) values."""
    observed = observed_columns(df, variables, suffix)
    if summaries is None:
        summaries = summarize_columns(observed, variables, QUARTILES)
    return _with_outlier_counts(observed, summaries)


def outlier_rows(df: DataFrame, variable: str, suffix: str = "_imputed") -> DataFrame:
    """The rows whose observed value lies outside its IQR limits.

    Limits of a whole-number column are rounded inwards to whole numbers, so that the comparison needs no cast and
    the filter is pushed to the scan.
    """
    summary = summarize_columns(observed_columns(df, [variable], suffix), [variable], QUARTILES)[variable]
    _, low, high = _limits(summary)
    if low is not None and isinstance(df.schema[variable].dataType, IntegralType):
        low, high = math.ceil(low), math.floor(high)
    return df.where(outside(observed_value(df, variable, suffix), low, high))


def bin_count(n: int) -> int:
    """Number of equal-width bins for ``n`` values: the square root, kept between 5 and 12."""
    return min(12, max(5, math.isqrt(n)))


def _bins(summary: ColumnSummary) -> int:
    if not summary.n:
        return 0
    return 1 if math.isclose(summary.minimum, summary.maximum) else bin_count(summary.n)


def histogram_bins(
    df: DataFrame,
    variables: Sequence[str],
    suffix: str = "_imputed",
    summaries: Mapping[str, ColumnSummary] | None = None,
) -> DataFrame:
    """Equal-width histograms of the observed values; empty bins are kept and the last bin is closed."""
    observed = observed_columns(df, variables, suffix)
    if summaries is None:
        summaries = summarize_columns(observed, variables)
    frame, cells = [], []
    for name in variables:
        summary, bins = summaries[name], _bins(summaries[name])
        if not bins:
            continue
        low, step = summary.minimum, (summary.maximum - summary.minimum) / bins
        if bins == 1:
            frame.append((name, 0, low, summary.maximum))
            number = F.when(F.col(f"`{name}`").isNotNull(), F.lit(0))
        else:
            frame += [(name, i, low + i * step, low + (i + 1) * step) for i in range(bins)]
            # least() passes over NULL, so a missing value needs its own guard.
            place = F.least(F.floor((F.col(f"`{name}`") - F.lit(low)) / F.lit(step)), F.lit(bins - 1)).cast("int")
            number = F.when(F.col(f"`{name}`").isNotNull(), place)
        cells.append(F.struct(F.lit(name).alias("variable"), number.alias("bin")))
    skeleton = df.sparkSession.createDataFrame(frame, "variable string, bin int, lower double, upper double")
    if not cells:
        return skeleton.withColumn("n", F.lit(0).cast("long"))
    counts = (
        observed.select(F.inline(F.array(*cells)))
        .where(F.col("bin").isNotNull())
        .groupBy("variable", "bin")
        .agg(F.count("*").alias("n"))
    )
    return skeleton.join(F.broadcast(counts), ["variable", "bin"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0).cast("long"))
    )


def boxplot_stats(
    df: DataFrame,
    variables: Sequence[str],
    suffix: str = "_imputed",
    summaries: Mapping[str, ColumnSummary] | None = None,
) -> DataFrame:
    """Box statistics with whiskers at the IQR limits, clipped to the extremes, and their places on [0, 1]."""
    box = (
        iqr_summary(df, variables, suffix, summaries)
        .withColumn("whisker_low", F.greatest("minimum", "lower_limit"))
        .withColumn("whisker_high", F.least("maximum", "upper_limit"))
    )
    places = {
        f"{name}_at": min_max_scale(F.col(name), F.col("minimum"), F.col("maximum"))
        for name in ("whisker_low", "q1", "median", "q3", "whisker_high")
    }
    return box.select(
        "variable", "n", "minimum", "whisker_low", "q1", "median", "q3", "whisker_high", "maximum", "n_outliers",
        *[value.alias(name) for name, value in places.items()],
    )


def distribution_bundle(
    df: DataFrame,
    variables: Sequence[str],
    suffix: str = "_imputed",
    summaries: Mapping[str, ColumnSummary] | None = None,
) -> dict[str, DataFrame]:
    """Histogram and box tables of all variables; the summaries behind both are taken once."""
    if summaries is None:
        summaries = summarize_columns(observed_columns(df, variables, suffix), variables, QUARTILES)
    return {
        "histograms": histogram_bins(df, variables, suffix, summaries),
        "boxplots": boxplot_stats(df, variables, suffix, summaries),
    }


def scale_column(df: DataFrame, column: str, start: float = 0.0, end: float = 1.0, name: str | None = None) -> DataFrame:
    """Add ``column`` mapped from its own range to [start, end]; the range is a one-row scalar subquery."""
    value = F.col(column).cast("double")
    extent = df.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high")).alias("extent")).scalar()
    return df.withColumn(name or f"{column}_scaled", min_max_scale(value, extent["low"], extent["high"], start, end))
