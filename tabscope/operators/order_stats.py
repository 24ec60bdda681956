"""Exact order statistics and quantiles of whole columns, without sorting or collecting them.

``percentile`` keeps every distinct value of a column in one task. Here each pass counts values per bucket (a
map-side combined ``groupBy`` of a bounded number of buckets) and the next pass looks only inside the bucket that
holds a wanted rank. The first pass cuts by magnitude, so that the values of a bucket differ by a few percent; later
ones cut a bucket evenly, each gaining ten bits of the 52 that are left at most. So six passes settle any values, from
the smallest to infinities, and fewer do when a bucket holds so few rows that its values are counted one by one.
The buckets of the wanted ranks are found in Spark; the driver receives one row per column and rank.

Every pass reads its input again: stage a table that comes from joins or groupings before calling. Columns weighed by
distinct value are read once: their distinct values are written, by one shuffle for any number of ranks, and every pass
counts the rows of that table instead.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tabscope.functions.numbers import nan_to_null
from tabscope.session import stage, unstage

BUCKETS = 1024
LISTED = 16384
# Buckets per doubling of the first pass, and the doublings between the smallest and the largest double.
GRID = 32
LOWEST_DOUBLING, HIGHEST_DOUBLING = -1075, 1025


@dataclass(frozen=True)
class ColumnSummary:
    """Count of present values, extremes and requested quantiles of one column; None where it is empty."""

    n: int
    minimum: float | None
    maximum: float | None
    quantiles: dict[float, float | None] = field(default_factory=dict)


@dataclass(frozen=True)
class _Interval:
    """Values of a place in [low, high], the smallest of rank ``first``, and the ranks still open among them."""

    place: int
    low: float
    high: float
    first: int
    count: int
    ranks: tuple[int, ...]

    @property
    def listed(self) -> bool:
        """Few enough rows to count every value."""
        return self.count <= LISTED

    def holds(self, value: Column) -> Column:
        return value.between(F.lit(self.low), F.lit(self.high))

    def bucket(self, value: Column, buckets: int) -> Column:
        """Non-decreasing number of the even step a value falls in."""
        if self.listed:
            return F.lit(0).cast("long")
        step = (value - F.lit(self.low)) / F.lit(self.high - self.low)
        return F.least(F.floor(step * F.lit(float(buckets))), F.lit(buckets - 1)).cast("long")


@dataclass(frozen=True)
class _Series:
    """The columns under study, each weighed by row or by distinct value: a place is a position in ``columns``.

    ``numbers`` has a column for each; ``single`` a row (place, value) for each distinct value of those weighed so.
    """

    numbers: DataFrame
    columns: tuple[str, ...]
    single: DataFrame | None
    distinct: frozenset[int]

    def close(self) -> None:
        """Delete the table of distinct values."""
        if self.single is not None:
            unstage(self.single)

    def value(self, place: int) -> Column:
        """The value of a place in a row of the table that is counted for it; NULL in rows of other places."""
        if place in self.distinct:
            return F.when(F.col("place") == place, F.col("value"))
        return F.col(f"`{self.columns[place]}`")

    def located(self, cells: list[tuple[int, Column]], wanted: Column, first: Column) -> list[Row]:
        """Count ``cells`` (with their places, structs of place, part, cell, exact, value; NULL cells are left out), and
        return those that hold a wanted rank with their extremes, first rank, and the size and extremes of their part."""
        by_row = [cell for place, cell in cells if place not in self.distinct]
        by_value = [cell for place, cell in cells if place in self.distinct]
        tables = [(self.numbers, by_row), (self.single, by_value)]
        counted = [table.select(F.inline(F.array(*own))) for table, own in tables if own]
        rows = (counted[0].unionByName(counted[1]) if len(counted) > 1 else counted[0]).where(F.col("cell").isNotNull())
        counts = [F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")]
        counted = rows.groupBy("place", "part", "cell", "exact").agg(*counts)
        part = Window.partitionBy("part")
        before = part.orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
        placed = counted.withColumns(
            {
                "total": F.sum("n").over(part),
                "least": F.min("lo").over(part),
                "greatest": F.max("hi").over(part),
                "first": first + F.coalesce(F.sum("n").over(before), F.lit(0)),
            }
        ).withColumn("wanted", wanted)
        held = F.filter("wanted", lambda rank: (rank >= F.col("first")) & (rank < F.col("first") + F.col("n")))
        return placed.withColumn("ranks", F.array_distinct(held)).where(F.size("ranks") > 0).collect()

    def first_pass(self, wanted: Column) -> list[Row]:
        """Cells by magnitude; a part is a whole place."""
        cells = []
        for i in range(len(self.columns)):
            value = self.value(i)
            doubling = F.least(F.log2(F.abs(value)), F.lit(float(HIGHEST_DOUBLING)))
            size = F.floor((doubling - F.lit(float(LOWEST_DOUBLING))) * F.lit(float(GRID))).cast("long")
            cell = F.when(value == 0, F.lit(0).cast("long")).otherwise(F.signum(value).cast("long") * size)
            cells.append((i, self._cell(i, i, cell, F.lit(None).cast("double"), value)))
        return self.located(cells, wanted, F.lit(0).cast("long"))

    def next_pass(self, intervals: Sequence[_Interval], buckets: int) -> list[Row]:
        """Cells inside each interval; a part is an interval."""
        cells = []
        for i, interval in enumerate(intervals):
            value = self.value(interval.place)
            cell = F.when(interval.holds(value), interval.bucket(value, buckets))
            exact = value if interval.listed else F.lit(None).cast("double")
            cells.append((interval.place, self._cell(interval.place, i, cell, exact, value)))
        at = F.col("part") + 1
        first = F.element_at(F.array(*[F.lit(interval.first).cast("long") for interval in intervals]), at)
        ranks = F.array(*[_longs(interval.ranks) for interval in intervals])
        return self.located(cells, F.element_at(ranks, at), first)

    @staticmethod
    def _cell(place: int, part: int, cell: Column, exact: Column, value: Column) -> Column:
        names = {"place": F.lit(place), "part": F.lit(part), "cell": cell, "exact": exact, "value": value}
        return F.struct(*[column.alias(name) for name, column in names.items()])

    def settle(self, rows: Sequence[Row], buckets: int) -> dict[tuple[int, int], float]:
        """Value of every rank that ``rows``, the located cells of the first pass, hold."""
        settled: dict[tuple[int, int], float] = {}
        while rows:
            intervals = []
            for row in rows:
                last, inner = row["first"] + row["n"] - 1, []
                for rank in row["ranks"]:
                    if rank == row["first"] or row["lo"] == row["hi"]:
                        settled[row["place"], rank] = row["lo"]
                    elif rank == last:
                        settled[row["place"], rank] = row["hi"]
                    else:
                        inner.append(rank)
                if inner:
                    found = (row["place"], row["lo"], row["hi"], row["first"], row["n"], tuple(inner))
                    intervals.append(_Interval(*found))
            rows = self.next_pass(intervals, buckets) if intervals else ()
        return settled


def _longs(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(value).cast("long") for value in values])


def _series(df: DataFrame, columns: Sequence[str], distinct: bool | Collection[str]) -> _Series:
    """Columns as doubles, NaN as missing and one zero, so that equal values are one value."""
    numbers = df.select(
        *[(nan_to_null(F.col(f"`{name}`").cast("double")) + F.lit(0.0)).alias(name) for name in columns]
    )
    by_value = set(columns) if distinct is True else set(distinct or ())
    places = [i for i, name in enumerate(columns) if name in by_value]
    single = None
    if places:
        pairs = [F.struct(F.lit(i).alias("place"), F.col(f"`{columns[i]}`").alias("value")) for i in places]
        single = numbers.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull()).distinct()
        single = stage(single, "distinct-values")
    return _Series(numbers, tuple(columns), single, frozenset(places))


def kth_values(
    df: DataFrame, ranks: Mapping[str, Sequence[int]], distinct: bool | Collection[str] = False, buckets: int = BUCKETS
) -> dict[tuple[str, int], float]:
    """Exact values at zero-based ``ranks`` of the sorted present values of each column."""
    columns = list(ranks)
    series = _series(df, columns, distinct)
    wanted = F.element_at(F.array(*[_longs(ranks[name]) for name in columns]), F.col("place") + 1)
    found = series.settle(series.first_pass(wanted), buckets)
    series.close()
    values = {(columns[place], rank): value for (place, rank), value in found.items()}
    outside = [(name, rank) for name in columns for rank in ranks[name] if (name, rank) not in values]
    if outside:
        raise ValueError(f"ranks outside the present values: {outside}")
    return values


def summarize_columns(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float] = (),
    distinct: bool | Collection[str] = False,
    buckets: int = BUCKETS,
) -> dict[str, ColumnSummary]:
    """Count, extremes and exact linearly interpolated quantiles of whole columns.

    Columns named in ``distinct`` (all, if True) weigh every distinct value once. All columns share each scan.
    """
    columns = list(dict.fromkeys(columns))
    series = _series(df, columns, distinct)
    empty = dict.fromkeys(probabilities)
    summaries = {name: ColumnSummary(0, None, None, dict(empty)) for name in columns}
    positions = [F.lit(float(p)) * (F.col("total") - 1) for p in probabilities]
    below = [F.floor(position).cast("long") for position in positions]
    above = [F.least(low + 1, F.col("total") - 1) for low in below]
    rows = series.first_pass(F.array(*below, *above, F.lit(0).cast("long")))
    values = series.settle(rows, buckets)
    series.close()
    for row in rows:
        n, quantiles = row["total"], {}
        for p in probabilities:
            position = p * (n - 1)
            rank = math.floor(position)
            low, high = values[row["place"], rank], values[row["place"], min(rank + 1, n - 1)]
            fraction = position - rank
            quantiles[p] = low if fraction == 0 or low == high else low + (high - low) * fraction
        summaries[columns[row["place"]]] = ColumnSummary(n, row["least"], row["greatest"], quantiles)
    return summaries


def medians(df: DataFrame, columns: Sequence[str], distinct: bool | Collection[str] = False) -> dict[str, float | None]:
    """Exact medians of present values, by row or (for columns in ``distinct``) over distinct values."""
    found = summarize_columns(df, columns, (0.5,), distinct)
    return {name: summary.quantiles[0.5] for name, summary in found.items()}
