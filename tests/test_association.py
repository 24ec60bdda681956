"""Contingency tests, quality rules, splits, metrics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscope.operators.contingency import (
    association_bars,
    chi_square_test,
    contingency_percent,
    contingency_table,
    expected_frequencies,
    result_comments,
)
from tabscope.operators.metrics import classification_metrics, confusion_matrix, confusion_shares, roc_auc
from tabscope.operators.quality import (
    BinaryRule,
    DerivedFlagRule,
    DomainRule,
    DuplicateRule,
    ForbiddenColumnRule,
    NotNullRule,
    RangeRule,
    TypeRule,
    assert_binary,
    assert_finite,
    level_report,
    quality_report,
    schema_report,
    unexpected_values,
)
from tabscope.operators import split as split_module
from tabscope.operators.split import class_quotas, hash_split, parts, split_summary, stratified_split


def _table(spark, counts):
    rows = [(level, target) for level, pair in counts.items() for target, n in enumerate(pair) for _ in range(n)]
    return spark.createDataFrame([*rows, (None, 1), ("a", None)], "level string, target int")


def test_yates_on_two_by_two(spark):
    df = _table(spark, {"a": (30, 10), "b": (15, 45)})
    row = chi_square_test(df, "level", "target").first()
    assert row["chi2"] == pytest.approx(22.2643, abs=1e-4) and row["dof"] == 1
    assert row["p_value"] == pytest.approx(math.erfc(math.sqrt(row["chi2"] / 2)), rel=1e-10)
    assert row["decision"] == "reject H0" and row["assumption"] == "met"


def test_three_by_two(spark):
    df = _table(spark, {"a": (30, 10), "b": (15, 45), "c": (5, 60)})
    row = chi_square_test(df, "level", "target").first()
    assert row["chi2"] == pytest.approx(54.36998, abs=1e-5) and row["dof"] == 2
    assert row["p_value"] == pytest.approx(1.56210e-12, rel=1e-5)
    assert row["cramers_v"] == pytest.approx(math.sqrt(row["chi2"] / 165))
    comments = [row["comment"] for row in result_comments(chi_square_test(df, "level", "target")).collect()]
    assert comments[1:] == ["level: reject H0", "V = 0.574, strong"]
    expected = {r["level"]: r["expected_positive"] for r in expected_frequencies(df, "level", "target").collect()}
    assert expected == {"a": pytest.approx(40 * 115 / 165), "b": pytest.approx(60 * 115 / 165), "c": pytest.approx(65 * 115 / 165)}


def test_degenerate_tables(spark):
    one_class = chi_square_test(_table(spark, {"a": (0, 3), "b": (0, 4)}), "level", "target").first()
    assert (one_class["chi2"], one_class["p_value"], one_class["dof"], one_class["cramers_v"]) == (0.0, 1.0, 0, 0.0)
    assert contingency_table(_table(spark, {"a": (0, 3)}), "level", "target").first()["n_negative"] == 0
    assert chi_square_test(_table(spark, {}), "level", "target").count() == 0
    bars = association_bars(_table(spark, {"a": (1, 2), "b": (3, 1)}), "level", "target").collect()
    assert [(row["level"], row["pct_positive"]) for row in bars] == [("b", 25.0), ("a", 66.67)]
    total = contingency_percent(_table(spark, {"a": (1, 2)}), "level", "target").first()
    assert total["n_total"] == 3 and total["pct_negative"] == 33.33


def _messy(spark):
    rows = [
        ("a", 1, 1, "x", 0.0), ("a", 1, 1, "x", 0.0), (None, 0, 0, "y", 5.0), ("b", 2, 1, "z", -1.0), ("c", None, 0, None, None),
    ]
    return spark.createDataFrame(rows, "src string, flag int, has_src int, kind string, amount double")


def test_quality_report(spark):
    rules = [
        DuplicateRule(), DuplicateRule(("kind",)), DerivedFlagRule("has_src", "src"), BinaryRule("flag"), BinaryRule("has_src"),
        RangeRule("amount", 0), RangeRule("amount", 0, strict=True), DomainRule("kind", ("x", "y")),
        DomainRule("src", ("a", "b", "c")), NotNullRule("kind"), ForbiddenColumnRule("src"), ForbiddenColumnRule("none"),
    ]
    rows = {row["rule_no"]: row for row in quality_report(_messy(spark), rules).collect()}
    assert [rows[i]["result"] for i in range(1, 13)] == [
        "1", "1", "1", "1", "0", "1", "3", "1", "0", "1", "included", "not included",
    ]
    fine = {i for i, row in rows.items() if row["decision"] == "no correction"}
    assert fine == {5, 9, 12}
    with pytest.raises(ValueError, match="absent"):
        quality_report(_messy(spark), [NotNullRule("absent")])


def test_all_levels_are_counted_and_listed(spark):
    df = spark.range(500).select(F.format_string("v%03d", "id").alias("c"), (F.col("id") % 3).alias("b"))
    assert unexpected_values(df, {"c": ["v000"]}).count() == 499
    rules = [DomainRule("c", ("v000",)), BinaryRule("b")]
    assert [row["result"] for row in quality_report(df, rules).orderBy("rule_no").collect()] == ["499", "1"]
    levels = level_report(df, rules, first_no=4)
    assert levels.where("rule_no = 4 AND variable = 'c' AND n = 1").count() == 499
    assert sorted(tuple(r) for r in levels.where("rule_no = 5").collect()) == [(5, "b", "0", 167), (5, "b", "1", 167), (5, "b", "2", 166)]
    assert level_report(df, [NotNullRule("c")]).collect() == []


def test_duplicate_rules_share_a_pass_and_treat_missing_as_equal(spark):
    long = "x" * 500
    rows = [(long, None, 0.0), (long, None, -0.0), (long, None, 1.0), (None, 1, float("nan")), (None, 1, None), ("null", 2, 2.0)]
    df = spark.createDataFrame(rows, "t string, i int, d double")
    report = quality_report(df, [DuplicateRule(), DuplicateRule(("t",)), DuplicateRule(("i", "d")), DuplicateRule(("t", "i", "d"))])
    assert [row["result"] for row in report.orderBy("rule_no").collect()] == ["2", "3", "2", "2"]


def test_targets_other_than_0_and_1_fail(spark):
    df = spark.createDataFrame([("a", 0, 0.1), ("a", 2, 0.2), ("b", None, 0.3)], "c string, y int, s double")
    for run in (contingency_table(df, "c", "y"), confusion_matrix(df, "y", "y"), roc_auc(df, "y", "s")):
        with pytest.raises(Exception, match="must be 0 or 1"):
            run.collect()


def test_assertions(spark):
    assert_binary(_messy(spark), ["has_src"])
    with pytest.raises(ValueError, match="flag"):
        assert_binary(_messy(spark), ["has_src", "flag"])
    half = spark.createDataFrame([(0.5,)], "f double")
    with pytest.raises(ValueError):
        assert_binary(half, ["f"])
    assert_finite(half, "f")
    for bad in (float("nan"), float("inf"), None):
        with pytest.raises(ValueError):
            assert_finite(spark.createDataFrame([(bad,), (0.1,)], "f double"), "f")


def test_splits(spark):
    df = spark.range(1000).withColumn("y", F.when(F.col("id") % 10 == 9, F.lit(None)).otherwise((F.col("id") % 5 == 0).cast("int")))
    split = stratified_split(df, "y", "id")
    rows = {row["split"]: row for row in split_summary(split, "y").collect()}
    assert rows["test"]["n_rows"] == 270 and rows["train"]["n_rows"] == 630
    assert rows["test"]["n_positive"] == 60 and rows["test"]["n_negative"] == 210
    again = stratified_split(df.repartition(7), "y", "id")
    assert split.exceptAll(again).count() == 0
    train, test = parts(split)
    assert train.count() + test.count() == 900 and not set(train.columns) ^ {"id", "y"}
    other = stratified_split(df, "y", "id", seed=7)
    assert split.exceptAll(other).count() > 0
    share = hash_split(df, "id").where("split = 'test'").count() / 1000
    assert 0.25 < share < 0.35

    def quotas(counts):
        rows = [(level,) for level, n in counts.items() for _ in range(n)]
        found = class_quotas(spark.createDataFrame(rows, "y int"), "y", 0.3)
        return {row["y"]: row["n_test"] for row in found.collect()}

    assert quotas({0: 49, 1: 350}) == {0: 15, 1: 105}
    assert sum(quotas({0: 3, 1: 3, 2: 5}).values()) == 4


@pytest.mark.parametrize("listed", [0, 7])
def test_split_by_longer_prefixes(spark, monkeypatch, listed):
    """Cells are narrowed until they are small, and remainders are placed by ranges: the same split."""
    df = spark.range(3000).withColumn("y", F.when(F.col("id") % 50 > 0, F.col("id") % 7))
    want = {tuple(row) for row in stratified_split(df, "y", "id").collect()}
    monkeypatch.setattr(split_module, "LISTED", listed)
    monkeypatch.setattr(split_module, "PREFIX_DIGITS", 1)
    assert {tuple(row) for row in stratified_split(df, "y", "id").collect()} == want


def test_split_with_thousands_of_classes(spark):
    df = spark.range(9000).withColumn("y", F.format_string("c%04d", F.col("id") % 1500))
    split = stratified_split(df, "y", "id")
    per_class = split.groupBy("y").agg(F.count_if(F.col("split") == "test").alias("n")).collect()
    assert len(per_class) == 1500 and {row["n"] for row in per_class} <= {1, 2}
    assert split.where("split = 'test'").count() == 2700


def test_metrics(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    score = np.round(rng.random(400) * 0.7 + y * 0.3, 1)
    said = (score >= 0.6).astype(int)
    df = spark.createDataFrame([(int(a), float(b), int(c)) for a, b, c in zip(y, score, said)], "y int, s double, p int")
    got = dict(map(tuple, classification_metrics(df, "y", "p", "s").collect()))
    counts = {(r, p): int(((y == r) & (said == p)).sum()) for r in (0, 1) for p in (0, 1)}
    precision = [counts[c, c] / max(counts[0, c] + counts[1, c], 1) for c in (0, 1)]
    recall = [counts[c, c] / (counts[c, 0] + counts[c, 1]) for c in (0, 1)]
    assert got["accuracy"] == pytest.approx((y == said).mean())
    assert got["precision_macro"] == pytest.approx(np.mean(precision))
    assert got["recall_macro"] == pytest.approx(np.mean(recall))
    assert got["f1_macro"] == pytest.approx(np.mean([2 * p * r / (p + r) for p, r in zip(precision, recall)]))
    positive, negative = score[y == 1], score[y == 0]
    wins = (positive[:, None] > negative).mean() + 0.5 * (positive[:, None] == negative).mean()
    assert got["roc_auc"] == pytest.approx(wins, abs=1e-12)
    flipped = roc_auc(df.withColumn("s", -F.col("s")), "y", "s").first()[0]
    assert flipped == pytest.approx(1 - wins, abs=1e-12)
    rows = {row["real"]: (row["predicted_0"], row["predicted_1"]) for row in confusion_matrix(df, "y", "p").collect()}
    assert rows == {r: (counts[r, 0], counts[r, 1]) for r in (0, 1)}
    shares = confusion_shares(df, "y", "p").agg(F.max("share"), F.count("*")).first()
    assert tuple(shares) == (1.0, 4)


def test_metrics_with_one_class(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "y int, p int")
    got = dict(map(tuple, classification_metrics(df, "y", "p").collect()))
    assert got == {"accuracy": 1.0, "precision_macro": 1.0, "recall_macro": 1.0, "f1_macro": 1.0}
    assert confusion_matrix(df, "y", "p").where("real = 0").first()["predicted_0"] == 0


def test_schema_report(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, "x", float("nan"))], "id long, leak string, score double")
    rules = [ForbiddenColumnRule("leak"), ForbiddenColumnRule("gone"), TypeRule("id", "bigint"), TypeRule("score", "int"), TypeRule("gone", "int")]
    rows = [tuple(row) for row in schema_report(df, rules).collect()]
    assert rows == [
        ("leak", "absent", "string", 1, "drop before modelling"),
        ("gone", "absent", "missing", 0, "no correction"),
        ("id", "type bigint", "bigint", 2, "no correction"),
        ("score", "type int", "double", 1, "cast before use"),
        ("gone", "type int", "missing", 0, "cast before use"),
    ]
    assert [row["n_values"] for row in schema_report(df.limit(0), rules[:1]).collect()] == [0]
