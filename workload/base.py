"""Registry, input tables and shared SQL pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.functions.numbers import round_half_even

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL where the semantics can be written in SQL."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the labels that cover some of them."""
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")


def orders_with_items(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the number and quantity of their items; both are missing where an order has none."""
    items = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.count("*").alias("n_items"), F.sum("l_quantity").alias("item_qty"))
    )
    return table(spark, sf, "orders").join(items, "o_orderkey", "left")


def scored_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with a fixed score of length and language, and the class it predicts."""
    score = F.col("n_chars") / (F.col("n_chars") + 1500.0) + F.when(F.col("lang") == "en", 0.1).otherwise(0.0)
    return (
        table(spark, sf, "documents")
        .join(table(spark, sf, "labels"), "doc_id")
        .select("doc_id", "quality", "toxic", score.alias("score"))
        .withColumn("prediction", (F.col("score") >= 0.55).cast("int"))
    )


def r6(column: Column | str) -> Column:
    """Six decimals, so that the order of a sum does not show."""
    return round_half_even(F.col(column) if isinstance(column, str) else column, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: r6(name) for name in names})


def R(expression: str) -> str:
    return f"round_even({expression}, 6)"


def PCT(part: str, whole: str) -> str:
    return f"round_even(CAST({part} AS DOUBLE) / nullif({whole}, 0) * 100, 2)"


LABELLED = """(SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

ORDER_ITEMS = """(SELECT o.*, i.n_items, i.item_qty FROM orders o LEFT JOIN
  (SELECT l_orderkey, count(*) AS n_items, sum(l_quantity) AS item_qty FROM lineitem GROUP BY l_orderkey) i
  ON o.o_orderkey = i.l_orderkey)"""

SCORED = """(SELECT *, CASE WHEN score >= 0.55 THEN 1 ELSE 0 END AS prediction FROM (
  SELECT d.doc_id, l.quality, l.toxic,
    d.n_chars / (d.n_chars + CAST(1500 AS DOUBLE)) + CASE WHEN d.lang = 'en' THEN CAST(0.1 AS DOUBLE) ELSE 0 END AS score
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id))"""


def summary_sql(variable: str, relation: str, observed: str = "TRUE") -> str:
    """Count, five numbers, limits and outliers of one numeric column."""
    return f"""SELECT '{variable}' AS variable, n, minimum, q1, median, q3, maximum, q3 - q1 AS iqr,
      q1 - 1.5 * (q3 - q1) AS lower_limit, q3 + 1.5 * (q3 - q1) AS upper_limit,
      (SELECT count(*) FROM {relation} WHERE {observed} AND ({variable} < q1 - 1.5 * (q3 - q1)
        OR {variable} > q3 + 1.5 * (q3 - q1))) AS n_outliers
    FROM (SELECT count({variable}) AS n, CAST(min({variable}) AS DOUBLE) AS minimum,
      CAST(max({variable}) AS DOUBLE) AS maximum,
      quantile_cont(CAST({variable} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({variable} AS DOUBLE), 0.5) AS median,
      quantile_cont(CAST({variable} AS DOUBLE), 0.75) AS q3 FROM {relation} WHERE {observed})"""


def iqr_sql(pieces: list[str]) -> str:
    numbers = ("minimum", "q1", "median", "q3", "maximum", "iqr", "lower_limit", "upper_limit")
    body = " UNION ALL ".join(f"({piece})" for piece in pieces)
    return f"""SELECT variable, n, {", ".join(f"{R(x)} AS {x}" for x in numbers)}, n_outliers,
      {PCT("n_outliers", "n")} AS pct_outliers FROM ({body})"""


def box_sql(pieces: list[str]) -> str:
    body = " UNION ALL ".join(f"({piece})" for piece in pieces)

    def place(x: str) -> str:
        return R(f"CASE WHEN minimum = maximum THEN 0.5 ELSE ({x} - minimum) / (maximum - minimum) END")

    low, high = "greatest(minimum, lower_limit)", "least(maximum, upper_limit)"
    return f"""SELECT variable, n, {R("minimum")} AS minimum, {R(low)} AS whisker_low, {R("q1")} AS q1,
      {R("median")} AS median, {R("q3")} AS q3, {R(high)} AS whisker_high, {R("maximum")} AS maximum, n_outliers,
      {place(low)} AS whisker_low_at, {place("q1")} AS q1_at, {place("median")} AS median_at, {place("q3")} AS q3_at,
      {place(high)} AS whisker_high_at FROM ({body})"""


def histogram_sql(variable: str, relation: str, observed: str = "TRUE") -> str:
    """Equal-width bins with empty bins kept; for columns that are not constant."""
    return f"""SELECT '{variable}' AS variable, CAST(b.bin AS INTEGER) AS bin, {R("s.lo + b.bin * s.step")} AS lower,
      {R("s.lo + (b.bin + 1) * s.step")} AS upper, count(v.x) AS n
    FROM (SELECT lo, bins, (hi - lo) / bins AS step FROM (
        SELECT CAST(min({variable}) AS DOUBLE) AS lo, CAST(max({variable}) AS DOUBLE) AS hi,
          least(12, greatest(5, CAST(floor(sqrt(count({variable}))) AS INTEGER))) AS bins
        FROM {relation} WHERE {observed})) s
    JOIN (SELECT unnest(range(0, 12)) AS bin) b ON b.bin < s.bins
    LEFT JOIN (SELECT CAST({variable} AS DOUBLE) AS x FROM {relation} WHERE {observed}) v
      ON least(CAST(floor((v.x - s.lo) / s.step) AS INTEGER), s.bins - 1) = b.bin
    GROUP BY b.bin, s.lo, s.step"""


def contingency_sql(rows: str, relation: str, target: str = "quality") -> str:
    return f"""(SELECT {rows} AS level, count(*) FILTER (WHERE {target} = 0) AS n_negative,
      count(*) FILTER (WHERE {target} = 1) AS n_positive, count(*) AS n_total
      FROM {relation} WHERE ({rows}) IS NOT NULL AND {target} IN (0, 1) GROUP BY 1)"""


def chi_square_sql(name: str, rows: str, relation: str, target: str = "quality") -> str:
    """The test by definition, cell by cell; the p-value by the series of the lower incomplete gamma function."""
    return f"""SELECT 'chi-square test of independence' AS test, '{name}' AS row_variable, '{target}' AS target,
      '{target} is independent of {name}' AS null_hypothesis, '{target} is associated with {name}' AS alternative_hypothesis,
      {R("chi2")} AS chi2, {R("p")} AS p_value, dof, CAST(0.05 AS DOUBLE) AS alpha,
      CASE WHEN p < 0.05 THEN 'reject H0' ELSE 'do not reject H0' END AS decision, {R("v")} AS cramers_v,
      CASE WHEN v < 0.1 THEN 'very weak' WHEN v < 0.3 THEN 'weak' WHEN v < 0.5 THEN 'moderate' ELSE 'strong' END AS strength,
      {R("min_expected")} AS min_expected, cells_below_5,
      CASE WHEN cells_below_5 = 0 THEN 'met' ELSE 'interpret with caution' END AS assumption
    FROM (SELECT *, sqrt(chi2 / (n * least(r - 1, 1))) AS v,
        1 - list_sum(list_transform(range(0, 80), lambda i: exp(-chi2 / 2 + (i + dof / 2.0) * ln(chi2 / 2)
          - lgamma(i + 1 + dof / 2.0)))) AS p
      FROM (SELECT max(r) AS r, max(n) AS n, CAST(max(r) - 1 AS INTEGER) AS dof, min(e) AS min_expected,
          count(*) FILTER (WHERE e < 5) AS cells_below_5,
          sum(pow(CASE WHEN r = 2 THEN abs(o - e) - least(0.5, abs(o - e)) ELSE abs(o - e) END, 2) / e) AS chi2
        FROM (SELECT o, CAST(n_total AS DOUBLE) * (sum(o) OVER (PARTITION BY side)) / (sum(o) OVER ()) AS e,
            CAST(sum(o) OVER () AS DOUBLE) AS n, count(*) OVER (PARTITION BY side) AS r
          FROM (SELECT n_total, 0 AS side, n_negative AS o FROM {contingency_sql(rows, relation, target)}
            UNION ALL SELECT n_total, 1 AS side, n_positive AS o FROM {contingency_sql(rows, relation, target)}))))"""
