"""Profiles, distributions, imputation, and the integration and cleaning flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.functions.recode import RecodeRule
from tabscope.operators.columns import union_reports
from tabscope.operators.impute import clean_stage, imputation_flags, median_impute
from tabscope.operators.order_stats import medians
from tabscope.operators.profile import (
    boxplot_stats,
    distinct_profile,
    distribution_bundle,
    duplicate_count,
    histogram_bins,
    iqr_summary,
    null_profile,
    outlier_rows,
)
from tabscope.operators.quality import BinaryRule, DerivedFlagRule, DomainRule, DuplicateRule, NotNullRule, RangeRule
from tabscope.plans.flows import CleanSpec, IntegrateSpec, cleaning_flow, integrate_flow
from tabscope.session import stage
from tabscope.sources.tables import literal_dimension
from workload.base import (
    LABELLED,
    ORDER_ITEMS,
    R,
    box_sql,
    histogram_sql,
    iqr_sql,
    labelled,
    orders_with_items,
    query,
    r6,
    rounded,
    summary_sql,
    table,
)

PRICES = ["l_extendedprice", "l_quantity", "l_discount"]
IQR_NUMBERS = ("minimum", "q1", "median", "q3", "maximum", "iqr", "lower_limit", "upper_limit")
BOX_NUMBERS = (
    "minimum", "whisker_low", "q1", "median", "q3", "whisker_high", "maximum",
    "whisker_low_at", "q1_at", "median_at", "q3_at", "whisker_high_at",
)

# -- profiles ----------------------------------------------------------------------------------------------------

_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")


@query(
    "null_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count(*) AS n_rows, count(*) - count({c}) AS n_missing, 7 AS n_columns FROM {LABELLED}"
        for c in _COLUMNS
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return null_profile(labelled(spark, sf))


@query(
    "distinct_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count(DISTINCT {c}) AS n_distinct FROM {LABELLED}"
        for c in ("lang", "source", "quality")
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_profile(labelled(spark, sf), ["lang", "source", "quality"])


def _median_rows(spark: SparkSession, found: dict[str, float | None]) -> DataFrame:
    return rounded(spark.createDataFrame(list(found.items()), "variable string, median double"), "median")


@query(
    "median_row_weighted",
    f"""SELECT 'l_quantity' AS variable, {R("median(l_quantity)")} AS median FROM lineitem
      UNION ALL SELECT 'l_extendedprice', {R("median(l_extendedprice)")} FROM lineitem""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _median_rows(spark, medians(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"]))


@query(
    "median_distinct_values",
    f"""SELECT 'l_quantity' AS variable, {R("median(DISTINCT l_quantity)")} AS median FROM lineitem
      UNION ALL SELECT 'l_extendedprice', {R("median(DISTINCT l_extendedprice)")} FROM lineitem""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    lineitem = table(spark, sf, "lineitem")
    return _median_rows(spark, medians(lineitem, ["l_quantity", "l_extendedprice"], distinct=True))


@query(
    "duplicate_count",
    """SELECT 'text' AS keys, count(*) - count(DISTINCT text) AS n_duplicates FROM documents
      UNION ALL SELECT 'row', (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM
        (SELECT lang, source, n_chars FROM documents) GROUP BY lang, source, n_chars))""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    return union_reports(
        duplicate_count(documents, ["text"]).select(F.lit("text").alias("keys"), "n_duplicates"),
        duplicate_count(documents.select("lang", "source", "n_chars")).select(
            F.lit("row").alias("keys"), "n_duplicates"
        ),
    )


# -- distributions -----------------------------------------------------------------------------------------------


@query("iqr_summary", iqr_sql([summary_sql(c, "lineitem") for c in PRICES] + [summary_sql("n_chars", "documents")]))
def _(spark: SparkSession, sf: str) -> DataFrame:
    both = union_reports(
        iqr_summary(table(spark, sf, "lineitem"), PRICES), iqr_summary(table(spark, sf, "documents"), ["n_chars"])
    )
    return rounded(both, *IQR_NUMBERS)


@query(
    "histogram_bins",
    " UNION ALL ".join(histogram_sql(c, "lineitem") for c in PRICES)
    + " UNION ALL "
    + histogram_sql("n_chars", "documents"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    both = union_reports(
        histogram_bins(table(spark, sf, "lineitem"), PRICES), histogram_bins(table(spark, sf, "documents"), ["n_chars"])
    )
    return rounded(both, "lower", "upper")


@query("boxplot_stats", box_sql([summary_sql(c, "lineitem") for c in PRICES] + [summary_sql("n_chars", "documents")]))
def _(spark: SparkSession, sf: str) -> DataFrame:
    both = union_reports(
        boxplot_stats(table(spark, sf, "lineitem"), PRICES), boxplot_stats(table(spark, sf, "documents"), ["n_chars"])
    )
    return rounded(both, *BOX_NUMBERS)


def _staged_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The joined columns written once: medians read their input several times."""
    joined = orders_with_items(spark, sf).select("o_orderkey", "n_items", "item_qty")
    return stage(joined, "orders")


def _filled(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with imputed item counts and quantities, flags kept."""
    return clean_stage(_staged_orders(spark, sf), ["n_items", "item_qty"])[0]


@query(
    "distribution_bundle",
    f"""SELECT variable, 'bin' AS part, CAST(bin AS INTEGER) AS place, lower AS at, n
      FROM ({histogram_sql("n_items", ORDER_ITEMS, "n_items IS NOT NULL")}
        UNION ALL {histogram_sql("item_qty", ORDER_ITEMS, "item_qty IS NOT NULL")})
      UNION ALL SELECT variable, 'whisker_high', 0, whisker_high, n_outliers
      FROM ({box_sql([summary_sql("n_items", ORDER_ITEMS), summary_sql("item_qty", ORDER_ITEMS)])})""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    bundle = distribution_bundle(_filled(spark, sf), ["n_items", "item_qty"])
    bins = bundle["histograms"].select(
        "variable", F.lit("bin").alias("part"), F.col("bin").alias("place"), r6("lower").alias("at"), "n"
    )
    whiskers = bundle["boxplots"].select(
        "variable",
        F.lit("whisker_high").alias("part"),
        F.lit(0).alias("place"),
        r6("whisker_high").alias("at"),
        F.col("n_outliers").alias("n"),
    )
    return union_reports(bins, whiskers)


# -- floating columns with NaN -----------------------------------------------------------------------------------

# ``value`` is NaN in error events; NaN is a missing value everywhere.
GAPPY = "(SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events)"


def _gappy(spark: SparkSession, sf: str) -> DataFrame:
    value = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    return stage(table(spark, sf, "events").select("event_id", "event_type", value.alias("value")), "gappy")


@query(
    "nan_null_profile",
    f"SELECT 'value' AS variable, count(*) AS n_rows, count(*) - count(value) AS n_missing, 3 AS n_columns FROM {GAPPY}",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return null_profile(_gappy(spark, sf), ["value"])


@query("nan_distinct_profile", f"SELECT 'value' AS variable, count(DISTINCT value) AS n_distinct FROM {GAPPY}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_profile(_gappy(spark, sf), ["value"])


@query(
    "nan_imputation",
    f"""SELECT event_id, {R("coalesce(value, m)")} AS value, CASE WHEN value IS NULL THEN 1 ELSE 0 END AS value_imputed
      FROM {GAPPY}, (SELECT median(value) AS m FROM {GAPPY})""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    filled, _ = clean_stage(_gappy(spark, sf), ["value"])
    return rounded(filled.select("event_id", "value", "value_imputed"), "value")


@query("nan_iqr_summary", iqr_sql([summary_sql("value", GAPPY)]))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(iqr_summary(_gappy(spark, sf), ["value"]), *IQR_NUMBERS)


@query("nan_histogram_bins", histogram_sql("value", GAPPY, "value IS NOT NULL"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(histogram_bins(_gappy(spark, sf), ["value"]), "lower", "upper")


@query(
    "nan_outlier_rows",
    f"""SELECT event_id, {R("value")} AS value FROM {GAPPY}, (SELECT quantile_cont(value, 0.25) AS q1,
      quantile_cont(value, 0.75) AS q3 FROM {GAPPY}) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(outlier_rows(_gappy(spark, sf), "value").select("event_id", "value"), "value")


# -- imputation --------------------------------------------------------------------------------------------------


@query(
    "imputation_flags",
    f"""SELECT doc_id, CASE WHEN quality IS NULL THEN 1 ELSE 0 END AS quality_imputed,
      CASE WHEN toxic IS NULL THEN 1 ELSE 0 END AS toxic_imputed FROM {LABELLED}""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    flagged = imputation_flags(labelled(spark, sf), ["quality", "toxic"])
    return flagged.select("doc_id", "quality_imputed", "toxic_imputed")


_IMPUTED = f"""SELECT o_orderkey, coalesce(CAST(n_items AS DOUBLE), m1) AS n_items, coalesce(item_qty, m2) AS item_qty,
    CASE WHEN n_items IS NULL THEN 1 ELSE 0 END AS n_items_imputed,
    CASE WHEN item_qty IS NULL THEN 1 ELSE 0 END AS item_qty_imputed, o_orderstatus, o_orderpriority
  FROM {ORDER_ITEMS}, (SELECT median(n_items) AS m1, median(DISTINCT item_qty) AS m2 FROM {ORDER_ITEMS})"""


@query("median_impute", f"SELECT o_orderkey, n_items, item_qty FROM ({_IMPUTED})")
def _(spark: SparkSession, sf: str) -> DataFrame:
    filled, _ = median_impute(_staged_orders(spark, sf), ["n_items", "item_qty"], distinct=["item_qty"])
    return filled.select("o_orderkey", "n_items", "item_qty")


@query("clean_stage", f"SELECT o_orderkey, n_items, item_qty, n_items_imputed, item_qty_imputed FROM ({_IMPUTED})")
def _(spark: SparkSession, sf: str) -> DataFrame:
    filled, _ = clean_stage(_staged_orders(spark, sf), ["n_items", "item_qty"], distinct=["item_qty"])
    return filled.select("o_orderkey", "n_items", "item_qty", "n_items_imputed", "item_qty_imputed")


# -- flows -------------------------------------------------------------------------------------------------------

# Service hours per priority; one priority has none, as in a dimension with partial coverage.
SERVICE_HOURS = [("1 Urgent", 24), ("2 High", 48), ("3, Medium", 72), ("5 Low.", 240)]
PRIORITIES = IntegrateSpec(
    key="o_orderpriority",
    dim_key="priority_name",
    counted="o_orderkey",
    count_name="orders_in_priority",
    match_flag="has_hours",
    match_source="hours",
    pad={"o_custkey": 5},
    present_flags={"has_items": "n_items"},
    missing_flags={"items_missing": "n_items"},
    year=("order_year", "order_year_num", "order_age"),
    rates={"orders_per_10k_hours": ("orders_in_priority", "hours")},
    spread_by=["o_orderkey"],
)


@query(
    "integrate_flow",
    f"""SELECT o.o_orderkey, lpad(CAST(o.o_custkey AS VARCHAR), CAST(greatest(5, length(CAST(o.o_custkey AS VARCHAR))) AS INTEGER), '0')
        AS o_custkey, o.o_orderpriority, CASE WHEN o.n_items IS NULL THEN 0 ELSE 1 END AS has_items,
      CASE WHEN o.n_items IS NULL THEN 1 ELSE 0 END AS items_missing, CAST(2026 - year(o.o_orderdate) AS DOUBLE) AS order_age,
      count(*) OVER (PARTITION BY o.o_orderpriority) AS orders_in_priority, h.hours,
      CASE WHEN h.hours IS NULL THEN 0 ELSE 1 END AS has_hours,
      {R("count(*) OVER (PARTITION BY o.o_orderpriority) / CAST(h.hours AS DOUBLE) * 10000")} AS orders_per_10k_hours
    FROM {ORDER_ITEMS} o LEFT JOIN (VALUES ('1-URGENT', 24), ('2-HIGH', 48), ('3-MEDIUM', 72), ('5-LOW', 240))
      h(p, hours) ON o.o_orderpriority = h.p""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    fact = orders_with_items(spark, sf).withColumn("order_year", F.year("o_orderdate"))
    hours = literal_dimension(spark, SERVICE_HOURS, "priority_name string, hours int")
    joined = integrate_flow(fact, hours, PRIORITIES)
    return rounded(joined, "orders_per_10k_hours").select(
        "o_orderkey", "o_custkey", "o_orderpriority", "has_items", "items_missing", "order_age", "orders_in_priority",
        "hours", "has_hours", "orders_per_10k_hours",
    )


URGENCY = (
    RecodeRule("prefix", "1", "fast"),
    RecodeRule("contains", "HIGH", "fast"),
    RecodeRule("contains", "MEDIUM", "normal"),
)
ORDERS_CLEAN = CleanSpec(
    columns=("o_orderkey", "o_orderstatus", "o_orderpriority", "has_items", "n_items", "item_qty"),
    impute=("n_items", "item_qty"),
    distinct_medians=("item_qty",),
    binary=("has_items", "n_items_imputed", "item_qty_imputed"),
    numeric=("n_items", "item_qty"),
    recodes={"urgency": ("o_orderpriority", URGENCY, "slow")},
    source_rules=(DuplicateRule(("o_custkey",)), DerivedFlagRule("has_items", "n_items")),
    rules=(
        BinaryRule("has_items"),
        RangeRule("n_items", 1),
        RangeRule("item_qty", 10, strict=True),
        DomainRule("urgency", ("fast", "normal")),
        NotNullRule("urgency"),
    ),
)


def _cleaned(spark: SparkSession, sf: str):
    flagged = orders_with_items(spark, sf).withColumn("has_items", F.col("n_items").isNotNull().cast("int"))
    return cleaning_flow(flagged, ORDERS_CLEAN)


@query(
    "cleaning_flow",
    f"""SELECT o_orderkey, o_orderstatus, o_orderpriority, 1 - n_items_imputed AS has_items, n_items, item_qty,
      n_items_imputed, item_qty_imputed, CASE WHEN starts_with(o_orderpriority, '1') OR contains(o_orderpriority, 'HIGH')
        THEN 'fast' WHEN contains(o_orderpriority, 'MEDIUM') THEN 'normal' ELSE 'slow' END AS urgency FROM ({_IMPUTED})""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _cleaned(spark, sf).table


@query(
    "cleaning_flow_outliers",
    iqr_sql([summary_sql(c, ORDER_ITEMS, f"{c} IS NOT NULL") for c in ("n_items", "item_qty")]),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_cleaned(spark, sf).outliers, *IQR_NUMBERS)


@query(
    "cleaning_flow_report",
    f"""SELECT 1 AS rule_no, 'duplicates by o_custkey' AS "check", CAST(count(*) - count(DISTINCT o_custkey) AS VARCHAR)
        AS result, 'review duplicates' AS decision FROM orders
      UNION ALL SELECT 2, 'has_items against present n_items', '0', 'no correction'
      UNION ALL SELECT 3, 'other values of has_items', '0', 'no correction'
      UNION ALL SELECT 4, 'n_items >= 1', CAST(count(*) FILTER (WHERE n_items < 1) AS VARCHAR), 'no correction'
        FROM ({_IMPUTED})
      UNION ALL SELECT 5, 'item_qty > 10', CAST(count(*) FILTER (WHERE item_qty <= 10) AS VARCHAR), 'review range'
        FROM ({_IMPUTED})
      UNION ALL SELECT 6, 'unexpected levels of urgency', '1', 'review recoding'
      UNION ALL SELECT 7, 'missing urgency', '0', 'no correction'""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _cleaned(spark, sf).report.select("rule_no", "check", "result", "decision")
