"""Imputation with exact medians."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.operators.columns import coalesce_constant, missing, require_columns, value_of
from tabscope.operators.order_stats import medians


def imputation_flags(df: DataFrame, variables: Sequence[str], suffix: str = "_imputed") -> DataFrame:
    """Add ``<variable><suffix>`` = 1 where the value is absent, before any fill."""
    require_columns(df, variables)
    return df.withColumns({f"{name}{suffix}": missing(value_of(df, name)) for name in variables})


def median_impute(
    df: DataFrame, variables: Sequence[str], distinct: Sequence[str] = ()
) -> tuple[DataFrame, dict[str, float | None]]:
    """Fill each variable with its median and return the medians used.

    Variables listed in ``distinct`` take the median of their distinct values, so that a value repeated on many
    rows (an attribute of the group a row belongs to) counts once.
    """
    require_columns(df, variables)
    used = medians(df, variables, distinct)
    typed = df.withColumns({name: F.col(name).cast("double") for name in variables})
    known = {name: used[name] for name in variables if used[name] is not None}
    return coalesce_constant(typed, known), {name: used[name] for name in variables}


def clean_stage(
    df: DataFrame, variables: Sequence[str], distinct: Sequence[str] = (), suffix: str = "_imputed"
) -> tuple[DataFrame, dict[str, float | None]]:
    """Flags first, then the fill."""
    return median_impute(imputation_flags(df, variables, suffix), variables, distinct)
