"""Projection, flags, casts and filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from tabscope.functions.numbers import nan_to_null


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    """Raise one error that names every absent column."""
    absent = [name for name in names if name not in df.columns]
    if absent:
        raise ValueError(f"columns not found: {absent}")


def select_required(df: DataFrame, names: Sequence[str]) -> DataFrame:
    require_columns(df, names)
    return df.select(*names)


def split_features_target(
    df: DataFrame, features: Sequence[str], target: str, key: Sequence[str] = ()
) -> DataFrame:
    """Key, features and the integer target, nothing else; both parts stay in one table, row by row."""
    require_columns(df, [*key, *features, target])
    return df.select(*key, *features, F.col(target).cast("int").alias(target))


def drop_rename(df: DataFrame, drop: Sequence[str] = (), rename: Mapping[str, str] | None = None) -> DataFrame:
    return df.drop(*drop).withColumnsRenamed(dict(rename or {}))


def value_of(df: DataFrame, name: str) -> Column:
    """A column with NaN as NULL, the one missing value, where its type has NaN."""
    column = F.col(f"`{name}`")
    return nan_to_null(column) if isinstance(df.schema[name].dataType, (DoubleType, FloatType)) else column


def present(column: Column) -> Column:
    """1 where a value is informed, else 0."""
    return column.isNotNull().cast("int")


def missing(column: Column) -> Column:
    """1 where a value is absent, else 0."""
    return column.isNull().cast("int")


def presence_flags(
    df: DataFrame, informed: Mapping[str, str] | None = None, absent: Mapping[str, str] | None = None
) -> DataFrame:
    """Add 0/1 columns: ``informed`` maps flag -> source (1 if present), ``absent`` the inverse."""
    flags = {flag: present(value_of(df, source)) for flag, source in (informed or {}).items()}
    flags |= {flag: missing(value_of(df, source)) for flag, source in (absent or {}).items()}
    return df.withColumns(flags)


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Strict casts by column; a value that does not fit fails the query, in ANSI mode or not. ``category`` means text."""

    def strict(name: str, kind: str) -> Column:
        value = F.col(name)
        cast = value.try_cast("string" if kind == "category" else kind)
        unfit = F.raise_error(F.concat(F.lit(f"{name} does not fit {kind}: "), value.cast("string"))).cast(cast_type(kind))
        return F.when(value.isNotNull() & cast.isNull(), unfit).otherwise(cast)

    def cast_type(kind: str) -> str:
        return "string" if kind == "category" else kind

    return df.withColumns({name: strict(name, kind) for name, kind in types.items()})


def coalesce_constant(df: DataFrame, fills: Mapping[str, Any]) -> DataFrame:
    """Fill missing values of each column with its scalar."""
    return df.withColumns({name: F.coalesce(value_of(df, name), F.lit(value)) for name, value in fills.items()})


def observed_value(df: DataFrame, variable: str, suffix: str = "_imputed") -> Column:
    """The variable where it was observed: NULL on rows its imputation flag marks, if it has one."""
    value = value_of(df, variable)
    flag = f"{variable}{suffix}"
    return F.when(F.col(flag) == 0, value) if flag in df.columns else value


def filter_observed(df: DataFrame, variable: str, suffix: str = "_imputed") -> DataFrame:
    """Rows with a present, not imputed value."""
    present_rows = df.where(value_of(df, variable).isNotNull())
    flag = f"{variable}{suffix}"
    return present_rows.where(F.col(flag) == 0) if flag in df.columns else present_rows


def sort_table(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Total order by one key: a range-partitioned sort."""
    return df.orderBy(F.col(column).desc() if descending else F.col(column).asc())


def union_reports(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Append tables with the same columns, matched by name."""
    result = first
    for table in rest:
        result = result.unionByName(table)
    return result
