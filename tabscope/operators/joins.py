"""Enrichment joins and per-key counts that survive a key holding a large share of the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, NumericType, StructType

from tabscope.operators.columns import require_columns
from tabscope.session import stage

BROADCAST_BYTES = 64 * 1024 * 1024
# A key holding more than 1 / HOT_SHARE of the rows is hot; its rows are cut into pieces of about that size.
HOT_SHARE = 1000
TRACKED_KEYS = 8192


def _row_bytes(df: DataFrame) -> Column:
    """Measured width of one row: text by its length, nested values by their JSON, the rest by 8 bytes."""
    widths = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (ArrayType, MapType, StructType)):
            widths.append(F.octet_length(F.to_json(F.struct(column))))
        elif field.dataType.typeName() in ("string", "binary"):
            widths.append(F.octet_length(column))
        else:
            widths.append(F.lit(8))
    return sum((F.coalesce(width, F.lit(0)) for width in widths), F.lit(8)).cast("long")


def _hashable(df: DataFrame, name: str) -> Column:
    column = F.col(f"`{name}`")
    return F.to_json(F.struct(column)) if isinstance(df.schema[name].dataType, (ArrayType, MapType, StructType)) else column


def measure_dimension(dim: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(bytes, largest number of rows sharing one key) of a join side, in one job. NULL keys are left out."""
    per_key = (
        dim.select(*keys, _row_bytes(dim).alias("__bytes"))
        .dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(F.count("*").alias("__rows"), F.sum("__bytes").alias("__bytes"))
    )
    row = per_key.agg(F.sum("__bytes").alias("bytes"), F.max("__rows").alias("rows")).first()
    return row["bytes"] or 0, row["rows"] or 0


def measured_bytes(df: DataFrame) -> int:
    """Bytes of a table's rows, from one aggregate."""
    return df.agg(F.sum(_row_bytes(df))).first()[0] or 0


def hot_keys(df: DataFrame, keys: Sequence[str]) -> tuple[list[int], int]:
    """Hashes of the keys (NULL included) that hold a large share of the rows, and the pieces to cut them into.

    One scan of the key columns with a sketch of bounded size; it decides how work is spread, never what is joined.
    """
    hashed = F.xxhash64(*[F.col(key) for key in keys])
    sketch = F.expr(f"approx_top_k(hash, {HOT_SHARE}, {TRACKED_KEYS})")
    row = df.select(hashed.alias("hash")).agg(F.count("*").alias("n"), sketch.alias("top")).first()
    hot = [item for item in row["top"] or [] if item["count"] * HOT_SHARE > row["n"]]
    pieces = max((math.ceil(item["count"] * HOT_SHARE / row["n"]) for item in hot), default=1)
    return [item["item"] for item in hot], min(pieces, HOT_SHARE)


def _typed_like(dim: DataFrame, fact: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The dimension with its keys in the types of the fact table, so that equal keys have equal hashes."""
    for key in keys:
        own, wanted = dim.schema[key].dataType, fact.schema[key].dataType
        if own != wanted:
            if not (isinstance(own, NumericType) and isinstance(wanted, NumericType)):
                raise ValueError(f"key {key} is {wanted.simpleString()} on one side and {own.simpleString()} on the other")
            dim = dim.withColumn(key, F.col(key).try_cast(wanted))
    return dim


def lookup_join(
    fact: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    size: int,
    spread_by: Sequence[str] | None = None,
    null_safe: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Left join of ``fact`` to a ``dim`` with unique keys whose measured ``size`` is given in bytes.

    A side within ``broadcast_bytes`` is broadcast and the fact table is not shuffled. A larger one is joined by
    shuffle, with the rows of hot keys (also of a hot NULL) spread over pieces by a hash of ``spread_by``, by default all
    columns beside the key. Only the dimension rows of hot keys are repeated, once per piece.
    """
    renamed = {key: f"__dim_{key}" for key in keys}
    dim = _typed_like(dim, fact, keys).withColumnsRenamed(renamed)

    def matches(left: DataFrame) -> list[Column]:
        pairs = [(left[key], F.col(other)) for key, other in renamed.items()]
        return [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs]

    if size <= broadcast_bytes:
        return fact.join(F.broadcast(dim), matches(fact), "left").drop(*renamed.values())
    hot, pieces = hot_keys(fact, keys)
    if not hot:
        return fact.join(dim, matches(fact), "left").drop(*renamed.values())
    spread = [_hashable(fact, name) for name in spread_by or [name for name in fact.columns if name not in keys]]
    piece = F.pmod(F.xxhash64(*spread) if spread else F.lit(0), F.lit(pieces)).cast("int")
    salted = fact.withColumn("__salt", F.when(F.xxhash64(*keys).isin(hot), piece).otherwise(F.lit(0)))
    copies = F.when(F.xxhash64(*renamed.values()).isin(hot), F.lit(pieces - 1)).otherwise(F.lit(0))
    repeated = dim.withColumn("__dim_salt", F.explode(F.sequence(F.lit(0), copies)))
    joined = salted.join(repeated, [*matches(salted), F.col("__salt") == F.col("__dim_salt")], "left")
    return joined.drop("__salt", "__dim_salt", *renamed.values())


def enrich_left_join(
    fact: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    flag: str | None = None,
    flag_source: str | None = None,
    spread_by: Sequence[str] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    suffix: str | None = None,
) -> DataFrame:
    """Add the columns of ``dim`` to every fact row; ``flag`` marks the rows that found ``flag_source``.

    Columns of ``dim`` that the fact also has get ``suffix``; without one they are refused before any job runs.
    ``flag_source`` is named as in ``dim``. One job measures the dimension: a repeated key is refused (it would
    multiply fact rows) and the measured size picks broadcast or shuffle. NULL keys match nothing.
    """
    require_columns(fact, keys)
    require_columns(dim, keys)
    source = flag_source or next((name for name in dim.columns if name not in keys), None)
    shared = [name for name in dim.columns if name not in keys and name in fact.columns]
    renamed = {name: f"{name}{suffix}" for name in shared} if suffix else {}
    taken = [name for name in shared if renamed.get(name, name) in [*fact.columns, *dim.columns]]
    if taken:
        raise ValueError(f"columns on both sides of the join: {taken}; give a suffix that makes them unique")
    dim, source = dim.withColumnsRenamed(renamed), renamed.get(source, source)
    size, rows = measure_dimension(dim, keys)
    if rows > 1:
        raise ValueError(f"dimension keys {list(keys)} are not unique: one key has {rows} rows")
    joined = lookup_join(
        fact, dim.dropna(subset=list(keys)), keys, size, spread_by, broadcast_bytes=broadcast_bytes
    )
    if flag is None:
        return joined
    if source is None:
        raise ValueError("the dimension has no column that could mark a match")
    return joined.withColumn(flag, F.col(source).isNotNull().cast("int"))


def join_coverage(df: DataFrame, flag: str, name: str = "coverage_pct") -> DataFrame:
    """Share of rows, in percent, whose match flag is 1."""
    return df.agg((F.avg(F.col(flag).cast("double")) * 100.0).alias(name))


def group_count_broadcast(
    df: DataFrame,
    keys: Sequence[str],
    counted: str,
    name: str,
    spread_by: Sequence[str] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Number of non-missing ``counted`` values of each row's key, on every row.

    Counts are combined map-side, written once, and joined back, so a key holding most rows never meets in one task as
    it would in a window. Rows with a NULL key form one group.
    """
    require_columns(df, [*keys, counted])
    counts = stage(df.groupBy(*keys).agg(F.count(counted).alias(name)), "counts")
    return lookup_join(df, counts, keys, measured_bytes(counts), spread_by, null_safe=True, broadcast_bytes=broadcast_bytes)
