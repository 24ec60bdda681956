"""Sources, sinks, projections, scalar functions, joins, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType

from tabscope.functions.numbers import (
    age_from_year,
    band_label,
    coerce_numeric,
    rate_per,
    strict_numeric,
)
from tabscope.functions.recode import RecodeRule, collapse_levels, recode
from tabscope.functions.text import normalize_key, zero_pad_code
from tabscope.operators.columns import (
    cast_columns,
    coalesce_constant,
    drop_rename,
    filter_observed,
    presence_flags,
    select_required,
    sort_table,
    split_features_target,
    union_reports,
)
from tabscope.operators.impute import imputation_flags
from tabscope.operators.joins import enrich_left_join, group_count_broadcast, join_coverage
from tabscope.operators.models import top_coefficients
from tabscope.operators.profile import outlier_rows, scale_column, sorted_levels
from tabscope.operators.quality import unexpected_values
from tabscope.presets import TRAILING_ARTICLES
from tabscope.session import scratch_path
from tabscope.sources.tables import (
    literal_dimension,
    read_csv_checked,
    read_csv_table,
    read_report_bundle,
    write_report_bundle,
    write_table,
)
from workload.base import LABELLED, ORDER_ITEMS, R, labelled, orders_with_items, query, r6, rounded, table

CUSTOMER = (
    StructType()
    .add("c_custkey", LongType())
    .add("c_name", StringType())
    .add("c_nationkey", IntegerType())
    .add("c_acctbal", DoubleType())
    .add("c_mktsegment", StringType())
)

# -- sources and sinks -------------------------------------------------------------------------------------------


@query(
    "read_csv_table",
    """SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
      c_mktsegment FROM customer""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    balance = F.col("c_acctbal")
    marked = table(spark, sf, "customer").withColumn(
        "c_acctbal", F.when(balance < 0, F.lit("NA")).otherwise(balance.cast("string"))
    )
    path = write_table(marked.select(CUSTOMER.names), scratch_path(spark, "customer-csv"), "csv")
    return read_csv_table(spark, path, CUSTOMER)


@query(
    "read_csv_inferred",
    """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment,
      printf('%05d', c_nationkey) AS code, c_custkey % 3 = 0 AS flag FROM customer""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Types come from the texts alone: whole and decimal numbers, codes with leading zeros, booleans."""
    customer = table(spark, sf, "customer")
    code, flag = F.format_string("%05d", "c_nationkey"), F.col("c_custkey") % 3 == 0
    given = customer.select(*CUSTOMER.names, code.alias("code"), flag.alias("flag"))
    path = write_table(given, scratch_path(spark, "customer-csv"), "csv", mark=True)
    return read_csv_checked(spark, path, keep_codes=True).table


@query(
    "csv_rejected",
    """SELECT coalesce("column", '') AS "column", reason, count(*) AS n_values, CAST(sum(length(coalesce(v, ''))) AS BIGINT) AS chars
      FROM (SELECT CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN 'c_acctbal' ELSE 'c_nationkey' END AS "column",
          CASE WHEN c_custkey % 10 = 0 THEN 'number of fields' WHEN c_custkey % 10 = 1 THEN 'not a double' ELSE 'not a int' END
            AS reason, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN 'x' || c_custkey ELSE '1.5' END AS v
        FROM customer WHERE c_custkey % 10 < 3) GROUP BY ALL
      UNION ALL SELECT '', 'accepted', count(*), 0 FROM customer WHERE c_custkey % 10 >= 3""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """One line in ten has a field too few, one a text for a number, one a fraction for an integer."""
    key = F.col("c_custkey")
    fields = [
        key.cast("string"),
        F.col("c_name"),
        F.when(key % 10 == 2, "1.5").otherwise(F.col("c_nationkey").cast("string")),
        F.when(key % 10 == 1, F.concat(F.lit("x"), key)).otherwise(F.col("c_acctbal").cast("string")),
        F.when(key % 10 > 0, F.col("c_mktsegment")),
    ]
    path = scratch_path(spark, "lines")
    lines = table(spark, sf, "customer").select(F.concat_ws(",", *fields).alias(",".join(CUSTOMER.names)))
    lines.write.csv(path, header=True, sep="\u0001")  # one field a line, so that its commas are written as they are
    found = read_csv_checked(spark, path, CUSTOMER)
    counted = found.rejected.groupBy(F.coalesce("column", F.lit("")).alias("column"), "reason").agg(
        F.count("*").alias("n_values"), F.sum(F.length(F.coalesce("value", F.lit("")))).alias("chars")
    )
    accepted = found.table.agg(F.count("*").alias("n_values")).select(
        F.lit("").alias("column"), F.lit("accepted").alias("reason"), "n_values", F.lit(0).cast("long").alias("chars")
    )
    return union_reports(counted, accepted)


# The inline dimension of the example.
ZONES = [(0, "Àfrica, l'"), (1, "Amèriques, les"), (2, "Àsia"), (3, "Europa"), (4, "Orient Mitjà, L'")]


@query(
    "literal_dimension",
    """SELECT n.n_nationkey, n.n_name, z.zone, z.zone_key, 2025 AS zone_year, 'inline' AS zone_origin FROM nation n
      LEFT JOIN (VALUES (0, 'Àfrica, l''', 'l africa'), (1, 'Amèriques, les', 'les ameriques'), (2, 'Àsia', 'asia'),
        (3, 'Europa', 'europa'), (4, 'Orient Mitjà, L''', 'l orient mitja')) z(r, zone, zone_key) ON n.n_regionkey = z.r""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    constants = {"zone_year": 2025, "zone_origin": "inline"}
    zones = literal_dimension(spark, ZONES, "n_regionkey int, zone string", constants, ("zone", "zone_key"), TRAILING_ARTICLES)
    return table(spark, sf, "nation").join(F.broadcast(zones), "n_regionkey", "left").drop("n_regionkey")


@query("write_table", "SELECT * FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = write_table(table(spark, sf, "customer"), scratch_path(spark, "customer"))
    return spark.read.parquet(path)


@query(
    "write_report_bundle",
    """SELECT 'segments' AS report, c_mktsegment AS level, count(*) AS n FROM customer GROUP BY c_mktsegment
      UNION ALL SELECT 'nations', CAST(c_nationkey AS VARCHAR), count(*) FROM customer GROUP BY c_nationkey""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer")
    bundle = {
        "segments": customer.groupBy(F.col("c_mktsegment").alias("level")).agg(F.count("*").alias("n")),
        "nations": customer.groupBy(F.col("c_nationkey").cast("string").alias("level")).agg(F.count("*").alias("n")),
    }
    paths = write_report_bundle(bundle, scratch_path(spark, "bundle"))
    back = read_report_bundle(spark, paths)
    return union_reports(*[df.select(F.lit(name).alias("report"), "level", "n") for name, df in back.items()])


# -- projections, filters, flags ---------------------------------------------------------------------------------


@query("select_required", f"SELECT doc_id, lang, quality FROM {LABELLED}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return select_required(labelled(spark, sf), ["doc_id", "lang", "quality"])


@query(
    "split_features_target",
    f"SELECT doc_id, lang, n_chars, toxic, CAST(quality AS INTEGER) AS quality FROM {LABELLED} WHERE quality IS NOT NULL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    known = labelled(spark, sf).where(F.col("quality").isNotNull())
    return split_features_target(known, ["lang", "n_chars", "toxic"], "quality", ["doc_id"])


@query("drop_rename", f"SELECT doc_id, lang AS language, n_chars AS length, quality, toxic FROM {LABELLED}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return drop_rename(labelled(spark, sf), ["text", "source"], {"lang": "language", "n_chars": "length"})


@query(
    "presence_flag",
    f"""SELECT doc_id, CASE WHEN quality IS NULL THEN 0 ELSE 1 END AS has_quality,
      CASE WHEN toxic IS NULL THEN 1 ELSE 0 END AS toxic_missing FROM {LABELLED}""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    flagged = presence_flags(labelled(spark, sf), {"has_quality": "quality"}, {"toxic_missing": "toxic"})
    return flagged.select("doc_id", "has_quality", "toxic_missing")


@query("filter_observed", f"SELECT o_orderkey, n_items FROM {ORDER_ITEMS} WHERE n_items IS NOT NULL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    flagged = imputation_flags(orders_with_items(spark, sf), ["n_items"])
    filled = coalesce_constant(flagged, {"n_items": 0})
    return filter_observed(filled, "n_items").select("o_orderkey", "n_items")


@query(
    "outlier_rows",
    """SELECT doc_id, n_chars FROM documents, (SELECT quantile_cont(n_chars, 0.25) AS q1,
      quantile_cont(n_chars, 0.75) AS q3 FROM documents)
      WHERE n_chars < q1 - 1.5 * (q3 - q1) OR n_chars > q3 + 1.5 * (q3 - q1)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return outlier_rows(table(spark, sf, "documents"), "n_chars").select("doc_id", "n_chars")


@query("coalesce_constant", f"SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM {LABELLED}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return coalesce_constant(labelled(spark, sf), {"quality": -1, "toxic": 0}).select("doc_id", "quality", "toxic")


# -- scalar functions --------------------------------------------------------------------------------------------


@query(
    "normalize_key",
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(replace(replace(lower(regexp_replace(
      regexp_replace(text, '^\s+|\s+$', '', 'g'), '^(.*),\s*(l''|el|la|els|les)$', '\2 \1', 'i')),
      'l'' ', 'l '), 'l''', 'l ')), '[^\x00-\x7F]', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", normalize_key(F.col("text"), TRAILING_ARTICLES).alias("key"))


@query(
    "zero_pad_code",
    """SELECT o_orderkey, CASE WHEN o_orderkey >= 10000 THEN CAST(o_orderkey AS VARCHAR)
      ELSE lpad(CAST(o_orderkey AS VARCHAR), 5, '0') END AS code FROM orders""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", zero_pad_code(F.col("o_orderkey")).alias("code"))


@query(
    "coerce_numeric",
    """SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE)
      AS amount FROM events""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.col("value").cast("string"))
    return table(spark, sf, "events").select("event_id", coerce_numeric(text).alias("amount"))


@query(
    "strict_numeric",
    "SELECT event_id, CAST(CAST(value AS VARCHAR) AS DOUBLE) AS amount FROM events",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", strict_numeric(F.col("value").cast("string")).alias("amount"))


@query(
    "cast_columns",
    """SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '0' END AS INTEGER) AS filled,
      CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    filled = F.when(F.col("o_orderstatus") == "F", F.lit("1")).otherwise(F.lit("0"))
    raw = table(spark, sf, "orders").select("o_orderkey", filled.alias("filled"), "o_custkey")
    return cast_columns(raw, {"filled": "int", "o_custkey": "category"})


@query("age_from_year", "SELECT o_orderkey, CAST(2026 - year(o_orderdate) AS INTEGER) AS age FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", age_from_year(F.year("o_orderdate"), 2026).alias("age"))


@query(
    "rate_per_10k",
    f"SELECT o_orderkey, {R('n_items / nullif(o_totalprice, 0) * 10000')} AS items_per_10k FROM {ORDER_ITEMS}",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rate = rate_per(F.col("n_items"), F.col("o_totalprice"))
    return orders_with_items(spark, sf).select("o_orderkey", r6(rate).alias("items_per_10k"))


@query(
    "min_max_scale",
    f"""SELECT l_orderkey, l_linenumber, {R("(l_extendedprice - lo) / (hi - lo)")} AS price_scaled FROM lineitem,
      (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    scaled = scale_column(table(spark, sf, "lineitem"), "l_extendedprice", name="price_scaled")
    return rounded(scaled.select("l_orderkey", "l_linenumber", "price_scaled"), "price_scaled")


GOODS = (
    RecodeRule("prefix", "small", "small goods"),
    RecodeRule("contains", "ring", "rings"),
    RecodeRule("prefix", "red", "red goods"),
    RecodeRule("contains", "widget", "widgets"),
)


@query(
    "recode_prefix_contains",
    """SELECT p_partkey, CASE WHEN starts_with(p_name, 'small') THEN 'small goods' WHEN contains(p_name, 'ring') THEN 'rings'
      WHEN starts_with(p_name, 'red') THEN 'red goods' WHEN contains(p_name, 'widget') THEN 'widgets'
      ELSE 'other goods' END AS family FROM part""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", recode(F.col("p_name"), GOODS, "other goods").alias("family"))


@query("collapse_levels", "SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN lang ELSE 'other' END AS lang_group FROM documents")
def _(spark: SparkSession, sf: str) -> DataFrame:
    group = collapse_levels(F.col("lang"), ["en", "fr"], "other")
    return table(spark, sf, "documents").select("doc_id", group.alias("lang_group"))


@query(
    "band_label",
    """SELECT l_orderkey, l_linenumber, CASE WHEN x < 0.1 THEN 'very weak' WHEN x < 0.3 THEN 'weak'
      WHEN x < 0.5 THEN 'moderate' ELSE 'strong' END AS band
      FROM (SELECT *, l_discount * CAST(6 AS DOUBLE) AS x FROM lineitem)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    band = band_label(F.col("l_discount") * F.lit(6.0))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", band.alias("band"))


# -- joins and per-key counts ------------------------------------------------------------------------------------


@query(
    "enrich_left_join",
    f"""SELECT doc_id, lang, source, n_chars, quality, toxic, CASE WHEN quality IS NULL THEN 0 ELSE 1 END AS has_label
      FROM {LABELLED}""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").drop("text")
    return enrich_left_join(documents, table(spark, sf, "labels"), ["doc_id"], "has_label", "quality")


@query("join_coverage", f"SELECT {R('100.0 * count(quality) / count(*)')} AS coverage_pct FROM {LABELLED}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select("doc_id")
    joined = enrich_left_join(documents, table(spark, sf, "labels"), ["doc_id"], "has_label", "quality")
    return rounded(join_coverage(joined, "has_label"), "coverage_pct")


@query(
    "group_count_broadcast",
    "SELECT c_custkey, c_nationkey, count(c_name) OVER (PARTITION BY c_nationkey) AS customers_in_nation FROM customer",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_name")
    return group_count_broadcast(customer, ["c_nationkey"], "c_name", "customers_in_nation").drop("c_name")


@query(
    "enrich_hot_key",
    """SELECT 1 AS same, CASE WHEN e.event_id % 3 = 0 THEN 0 ELSE e.user_id END AS user_id, e.event_id, c.c_custkey AS buyer,
      c.c_name AS user_id_dim, CASE WHEN c.c_custkey IS NULL THEN 0 ELSE 1 END AS known FROM events e
      LEFT JOIN customer c ON CASE WHEN e.event_id % 3 = 0 THEN 0 ELSE e.user_id END = c.c_custkey - 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the rows has one key, the first column is constant, and a column name is on both sides."""
    user = F.when(F.col("event_id") % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("user_id"))
    events = table(spark, sf, "events").select(F.lit(1).alias("same"), user.alias("user_id"), "event_id")
    keyed = events.withColumn("user", F.col("user_id"))
    customer = table(spark, sf, "customer").select(
        (F.col("c_custkey") - 1).alias("user"), F.col("c_custkey").alias("buyer"), F.col("c_name").alias("user_id")
    )
    joined = enrich_left_join(keyed, customer, ["user"], "known", "buyer", broadcast_bytes=0, suffix="_dim")
    return joined.drop("user")


# -- sorts, limits, set operations -------------------------------------------------------------------------------


@query(
    "top_coefficients",
    f"""SELECT variable, coefficient FROM (SELECT CAST(l_suppkey AS VARCHAR) AS variable,
      {R("avg(l_discount) - 0.05")} AS coefficient FROM lineitem GROUP BY l_suppkey)
      ORDER BY abs(coefficient) DESC, variable LIMIT 12""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    effects = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("variable")).agg(
        r6(F.avg("l_discount") - 0.05).alias("coefficient")
    )
    return top_coefficients(effects)


@query("sort_table", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return sort_table(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")


@query(
    "sorted_levels",
    """SELECT DISTINCT 'lang' AS variable, lang AS value FROM documents
      UNION ALL SELECT DISTINCT 'source', source FROM documents""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return sorted_levels(table(spark, sf, "documents"), ["lang", "source"])


@query(
    "union_reports",
    """SELECT 'lang' AS report, lang AS level, count(*) AS n FROM documents GROUP BY lang
      UNION ALL SELECT 'role', role, count(*) FROM conversations GROUP BY role""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    reports = [
        table(spark, sf, name).groupBy(F.col(column).alias("level")).agg(F.count("*").alias("n")).select(
            F.lit(column).alias("report"), "level", "n"
        )
        for name, column in (("documents", "lang"), ("conversations", "role"))
    ]
    return union_reports(*reports)


@query(
    "unexpected_values",
    """SELECT 'lang' AS variable, lang AS value, count(*) AS n FROM documents WHERE lang NOT IN ('en', 'fr') GROUP BY lang
      UNION ALL SELECT 'event_type', event_type, count(*) FROM events WHERE event_type NOT IN ('view', 'click')
      GROUP BY event_type""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return union_reports(
        unexpected_values(table(spark, sf, "documents"), {"lang": ["en", "fr"]}),
        unexpected_values(table(spark, sf, "events"), {"event_type": ["view", "click"]}),
    )
