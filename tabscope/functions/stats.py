"""Closed-form test statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# SQL over the fields h (half the statistic) and dof of a struct x.
# erfc(sqrt(h)): the series of erf below h = 4, the continued fraction above it.
_ERFC_SQRT = """
CASE WHEN x.h < 4 THEN 1 - 2 / sqrt(pi()) * exp(-x.h) * aggregate(
    sequence(1, 60), named_struct('term', sqrt(x.h), 'total', sqrt(x.h)),
    (s, i) -> named_struct('term', s.term * x.h / (i + 0.5D), 'total', s.total + s.term * x.h / (i + 0.5D)),
    s -> s.total)
ELSE exp(-x.h) / sqrt(pi()) / aggregate(sequence(120, 1, -1), sqrt(x.h), (t, k) -> sqrt(x.h) + k / 2.0D / t) END
"""


def _tail_sum(first_log: str, half: str) -> str:
    """The dof / 2 terms h^(i + half) / gamma(i + half + 1) * exp(-h), summed from their logarithms."""
    return f"""
aggregate(slice(sequence(0, x.dof div 2), 2, x.dof div 2), named_struct('log', {first_log}, 'total', 0D),
    (s, i) -> named_struct('log', s.log + ln(x.h / (i + {half})), 'total', s.total + exp(s.log)), s -> s.total)
"""


def chi2_sf(statistic: str, dof: str) -> Column:
    """P(chi-square > ``statistic``) for the columns named, by finite sums for even and odd degrees of freedom.

    Logarithms keep large tables from overflowing and tiny tails exact. Without degrees of freedom the answer is 1.
    """
    even = _tail_sum("-x.h", "0D")
    odd = f"{_ERFC_SQRT} + {_tail_sum('ln(2 / sqrt(pi()) * sqrt(x.h)) - x.h', '0.5D')}"
    return F.expr(f"""
transform(
    array(named_struct('h', abs(CAST({statistic} AS DOUBLE)) / 2, 'dof', CAST({dof} AS INT))),
    x -> CASE WHEN x.h IS NULL OR x.dof IS NULL THEN NULL WHEN x.dof <= 0 OR x.h <= 0 THEN 1D
        WHEN x.dof % 2 = 0 THEN least({even}, 1D) ELSE least({odd}, 1D) END)[0]
""")


def cramers_v(statistic: Column, total: Column, rows: Column, columns: Column) -> Column:
    """Effect size of a contingency table; 0 where it is undefined."""
    scale = total.cast("double") * (F.least(rows, columns) - F.lit(1)).cast("double")
    return F.when(scale > 0, F.sqrt(statistic / scale)).otherwise(F.lit(0.0))
