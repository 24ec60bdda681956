"""Order statistics, profiles, imputation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscope.operators import order_stats
from tabscope.operators.impute import clean_stage, median_impute
from tabscope.operators.order_stats import kth_values, summarize_columns
from tabscope.operators.profile import (
    bin_count,
    boxplot_stats,
    distinct_profile,
    distribution_bundle,
    duplicate_count,
    histogram_bins,
    iqr_summary,
    null_profile,
    outlier_rows,
    scale_column,
)

PROBABILITIES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)


def _shapes():
    rng = np.random.default_rng(7)
    return {
        "normal": rng.normal(0, 1, 4001),
        "heavy": np.exp(rng.normal(0, 8, 4001)) * rng.choice([-1, 1], 4001),
        "few": rng.choice([1.0, 2.0, 2.5, 40.0], 4001),
        "hot": np.where(rng.random(4001) < 0.4, 20175.0, rng.integers(0, 10**6, 4001)),
        "close": 1e15 + rng.integers(0, 5, 4001),
        "tiny": rng.random(4001) * 1e-9,
        "constant": np.full(4001, 3.0),
    }


@pytest.mark.parametrize(("buckets", "listed"), [(1024, 16384), (64, 32), (4, 1)])
def test_exact_quantiles(spark, monkeypatch, buckets, listed):
    monkeypatch.setattr(order_stats, "LISTED", listed)
    shapes = _shapes()
    rows = list(zip(*[map(float, values) for values in shapes.values()]))
    df = spark.createDataFrame(rows, list(shapes)).repartition(4)
    df = df.unionByName(df.limit(3).select(*[F.lit(None).cast("double").alias(c) for c in df.columns]))
    df = df.unionByName(df.limit(1).select(*[F.lit(float("nan")).alias(c) for c in df.columns]))
    got = summarize_columns(df, list(shapes), PROBABILITIES, buckets=buckets)
    for name, values in shapes.items():
        assert got[name].n == len(values)
        assert (got[name].minimum, got[name].maximum) == (values.min(), values.max())
        expected = np.quantile(values, PROBABILITIES)
        assert [got[name].quantiles[p] for p in PROBABILITIES] == pytest.approx(expected, rel=1e-12, abs=1e-300)


@pytest.mark.parametrize("listed", [1, 16384])
def test_passes_are_few_for_any_values(spark, monkeypatch, listed):
    monkeypatch.setattr(order_stats, "LISTED", listed)
    passes = []
    located = order_stats._Series.located
    monkeypatch.setattr(order_stats._Series, "located", lambda self, *a: passes.append(1) or located(self, *a))
    rng = np.random.default_rng(8)
    wide = rng.choice([-1, 1], 3001) * 10.0 ** rng.uniform(-300, 300, 3001)
    dense = 1.0 + rng.random(3001) * 1e-12
    infinite = np.array([1.0, 2.0] + [math.inf] * 3 + [-math.inf])
    for values in (wide, dense, infinite, np.array([5e-324, 1e-323, 0.0, -0.0, 1.7e308, -1.7e308])):
        passes.clear()
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        got = summarize_columns(df, ["x"], (0.25, 0.5, 0.9))["x"]
        ordered = np.sort(values)
        for p, value in got.quantiles.items():
            low, rest = divmod(p * (len(values) - 1), 1)
            a, b = ordered[int(low)], ordered[min(int(low) + 1, len(values) - 1)]
            assert value == pytest.approx(a if rest == 0 or a == b else a + (b - a) * rest, rel=1e-12)
        assert len(passes) <= 6
    missing = spark.createDataFrame([(1.0,), (2.0,), (math.inf,), (math.inf,), (math.inf,)], "x double")
    assert summarize_columns(missing, ["x"], (0.5,))["x"].quantiles[0.5] == math.inf


def test_nan_is_missing_and_zero_has_no_sign(spark):
    rows = [(float(v),) for v in range(1, 21)] + [(float("nan"),), (float("nan"),)]
    df = spark.createDataFrame(rows, "x double")
    summary = iqr_summary(df, ["x"]).first()
    assert (summary["n"], summary["n_outliers"], summary["pct_outliers"]) == (20, 0, 0.0)
    assert outlier_rows(df, "x").count() == 0
    assert sum(row["n"] for row in histogram_bins(df, ["x"]).collect()) == 20
    assert null_profile(df).first()["n_missing"] == 2
    filled, used = clean_stage(df, ["x"])
    assert used == {"x": 10.5} and filled.where("x_imputed = 1 AND x = 10.5").count() == 2
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),)], "x double")
    assert distinct_profile(zeros, ["x"]).first()["n_distinct"] == 1


def test_distinct_quantiles(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "LISTED", 8)
    values = np.random.default_rng(1).integers(0, 300, 2000).astype(float) ** 3
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = summarize_columns(df, ["x"], (0.25, 0.5), distinct=True, buckets=16)["x"]
    unique = np.unique(values)
    assert got.n == len(unique)
    assert [got.quantiles[0.25], got.quantiles[0.5]] == pytest.approx(np.quantile(unique, [0.25, 0.5]), rel=1e-12)


def test_kth_values_and_empty_columns(spark):
    df = spark.createDataFrame([(5.0, None), (1.0, None), (5.0, None)], "x double, y double")
    assert kth_values(df, {"x": [0, 1, 2]}) == {("x", 0): 1.0, ("x", 1): 5.0, ("x", 2): 5.0}
    with pytest.raises(ValueError):
        kth_values(df, {"x": [3]})
    empty = summarize_columns(df, ["y"], (0.5,))["y"]
    assert (empty.n, empty.minimum, empty.quantiles[0.5]) == (0, None, None)


def test_medians_by_row_and_by_value(spark):
    rows = [(1.0, 10.0), (1.0, 10.0), (1.0, 10.0), (9.0, 30.0), (None, None), (5.0, 20.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    filled, used = median_impute(df, ["a", "b"], distinct=["b"])
    assert used == {"a": 1.0, "b": 20.0}
    assert filled.where("a = 1 AND b = 20").count() == 1
    cleaned, _ = clean_stage(df, ["a"])
    assert cleaned.where("a_imputed = 1").count() == 1 and cleaned.where("a IS NULL").count() == 0


def test_null_and_distinct_profiles(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", None, 1), (None, None, 2)], "s string, t string, n int")
    rows = {row["variable"]: row for row in null_profile(df).collect()}
    assert [rows[c]["n_missing"] for c in "stn"] == [1, 3, 0]
    assert rows["s"]["n_rows"] == 3 and rows["s"]["n_columns"] == 3
    exact = dict(map(tuple, distinct_profile(df, ["s", "t", "n"]).collect()))
    assert exact == {"s": 2, "t": 0, "n": 2}
    assert dict(map(tuple, distinct_profile(df, ["s", "n"], relative_error=0.02).collect())) == {"s": 2, "n": 2}


def test_duplicates_treat_missing_as_equal(spark):
    long = "x" * 500
    rows = [(long, None, 0.0), (long, None, -0.0), (long, None, 1.0), (None, 1, 1.0), (None, 1, 1.0), ("y", 2, 2.0)]
    df = spark.createDataFrame(rows, "t string, i int, d double")
    assert duplicate_count(df).first()[0] == 2
    assert duplicate_count(df, ["t"]).first()[0] == 3
    assert duplicate_count(df.limit(0)).first()[0] == 0


def test_iqr_skips_imputed_and_counts_outliers(spark):
    values = [float(v) for v in range(1, 21)] + [500.0]
    rows = [(v, 0) for v in values] + [(9999.0, 1), (None, 0)]
    df = spark.createDataFrame(rows, "x double, x_imputed int")
    row = iqr_summary(df, ["x"]).first()
    q1, q2, q3 = np.quantile(values, [0.25, 0.5, 0.75])
    assert (row["n"], row["q1"], row["median"], row["q3"], row["n_outliers"]) == (21, q1, q2, q3, 1)
    assert row["pct_outliers"] == 4.76 and row["maximum"] == 500.0
    assert [r["x"] for r in outlier_rows(df, "x").collect()] == [500.0]
    box = boxplot_stats(df, ["x"]).first()
    assert box["whisker_low"] == 1.0 and box["whisker_high"] == q3 + 1.5 * (q3 - q1)
    assert iqr_summary(df.where("x IS NULL"), ["x"]).first()["pct_outliers"] is None


def test_histograms(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(10, 3, 300)
    rows = [(float(v), 4.0, None) for v in values] + [(None, 4.0, None)]
    df = spark.createDataFrame(rows, "x double, same double, none double")
    bins = [row for row in histogram_bins(df, ["x", "same", "none"]).orderBy("variable", "bin").collect()]
    x = [row["n"] for row in bins if row["variable"] == "x"]
    assert x == np.histogram(values, bins=12)[0].tolist()
    assert [(row["n"], row["lower"], row["upper"]) for row in bins if row["variable"] == "same"] == [(301, 4.0, 4.0)]
    assert not [row for row in bins if row["variable"] == "none"]
    assert [bin_count(n) for n in (1, 30, 50, 100, 144, 10**9)] == [5, 5, 7, 10, 12, 12]
    assert sum(row["n"] for row in distribution_bundle(df, ["x"])["histograms"].collect()) == 300


def test_scale_column(spark):
    df = spark.createDataFrame([(2.0,), (6.0,), (4.0,)], "x double")
    got = sorted(row["x_scaled"] for row in scale_column(df, "x").collect())
    assert got == [0.0, 0.5, 1.0] and not math.isnan(got[1])
