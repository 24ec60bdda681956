"""Places of rows in a total order without a single task: range partitions, counted, and their offsets."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscope.session import stage


def placed(df: DataFrame, order: Sequence[Column], place: str = "place", first: int = 0) -> DataFrame:
    """``df`` with the place of each row under ``order``, counted from ``first``; a written table.

    Rows are dealt by ranges of ``order`` and numbered inside their range; a range begins where the ranges before it
    end. The driver receives one count per range. Rows that ``order`` does not tell apart come in any order. Give distinct
    rows, or enough columns, as equal ones share a range.
    """
    ranges = df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    ranges = stage(ranges, "ranges")
    counts = {row["__range"]: row["n"] for row in ranges.groupBy("__range").agg(F.count("*").alias("n")).collect()}
    used = sorted(counts)
    starts = list(accumulate((counts[i] for i in used), initial=first))
    if not used:
        return ranges.drop("__range").withColumn(place, F.lit(None).cast("long"))
    start = F.element_at(F.create_map(*[F.lit(x) for i, at in zip(used, starts) for x in (i, at)]), F.col("__range"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranges.withColumn(place, (start + inside - 1).cast("long")).drop("__range")
