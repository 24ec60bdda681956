"""Numeric columns: coercion, rates, scaling, rounding and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"

# Lower bounds (inclusive) of the strength bands of Cramér's V.
ASSOCIATION_BANDS = ((0.10, "very weak"), (0.30, "weak"), (0.50, "moderate"))
STRONGEST_BAND = "strong"


def coerce_numeric(text: Column) -> Column:
    """Text to double; whatever is not a plain decimal number becomes NULL."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def strict_numeric(text: Column) -> Column:
    """Text to double; a malformed value fails the query."""
    bad = F.raise_error(F.concat(F.lit("not a number: "), text))
    return F.when(text.isNull() | text.rlike(NUMBER), F.trim(text).try_cast("double")).otherwise(bad.cast("double"))


def nan_to_null(number: Column) -> Column:
    """NULL is the only missing value downstream."""
    return F.when(~F.isnan(number), number)


def zero_or_one(number: Column, name: str) -> Column:
    """The number where it is 0, 1 or missing; any other value fails the query."""
    bad = F.raise_error(F.concat(F.lit(f"{name} must be 0 or 1, found "), number.cast("string"))).cast("int")
    return F.when(number.isNull() | number.isin(0, 1), number.cast("int")).otherwise(bad)


def age_from_year(year: Column, reference_year: int) -> Column:
    return F.lit(reference_year) - year


def rate_per(count: Column, base: Column, scale: float = 10_000.0) -> Column:
    """``count`` per ``scale`` of ``base``; NULL where the base is zero or missing."""
    return F.try_divide(count.cast("double"), base.cast("double")) * F.lit(scale)


def round_half_even(number: Column, digits: int = 2) -> Column:
    """Scale, round half to even, unscale: the rounding of array libraries."""
    scale = float(10**digits)
    return F.rint(number * F.lit(scale)) / F.lit(scale)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return round_half_even(F.try_divide(part.cast("double"), whole.cast("double")) * 100.0, digits)


def nearly_equal(a: Column, b: Column, relative: float = 1e-9) -> Column:
    return F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * F.lit(relative)


def min_max_scale(value: Column, low: Column, high: Column, start: float = 0.0, end: float = 1.0) -> Column:
    """Map [low, high] to [start, end]; the midpoint when the two bounds coincide."""
    span = F.lit(float(end - start))
    scaled = F.lit(float(start)) + F.try_divide(value - low, high - low) * span
    middle = F.when(value.isNotNull(), F.lit((start + end) / 2.0))
    return F.when(nearly_equal(low, high), middle).otherwise(scaled)


def band_label(
    value: Column,
    bands: Sequence[tuple[float, str]] = ASSOCIATION_BANDS,
    last: str = STRONGEST_BAND,
) -> Column:
    """Label of the first band whose upper cut exceeds ``value``."""
    label = F.lit(last)
    for cut, name in reversed(bands):
        label = F.when(value < cut, F.lit(name)).otherwise(label)
    return F.when(value.isNotNull(), label)


def decision_label(
    p_value: Column, alpha: float = 0.05, rejected: str = "reject H0", kept: str = "do not reject H0"
) -> Column:
    return F.when(p_value < alpha, F.lit(rejected)).when(p_value.isNotNull(), F.lit(kept))


def assumption_label(
    small_cells: Column, met: str = "met", unmet: str = "interpret with caution"
) -> Column:
    return F.when(small_cells == 0, F.lit(met)).when(small_cells.isNotNull(), F.lit(unmet))
