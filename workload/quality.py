"""Data-quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.operators.quality import (
    NO_ACTION,
    BinaryRule,
    DerivedFlagRule,
    DomainRule,
    DuplicateRule,
    ForbiddenColumnRule,
    NoteRule,
    NotNullRule,
    RangeRule,
    TypeRule,
    assert_binary,
    assert_finite,
    joint_report,
    level_report,
    quality_report,
    schema_report,
)
from workload.base import LABELLED, R, SCORED, labelled, query, rounded, scored_labels, table

_SOURCES = tuple(f"src{i}" for i in range(20))

DUPLICATES = (DuplicateRule(), DuplicateRule(("text",)), DuplicateRule(("lang", "quality"), "expected"))
DERIVED = (
    DerivedFlagRule("has_quality", "quality"),
    DerivedFlagRule("toxic_missing", "toxic", when_present=False),
    DerivedFlagRule("quality", "lang"),
)
BINARY = (BinaryRule("quality"), BinaryRule("toxic"), BinaryRule("thousands"))
RANGES = (RangeRule("l_quantity", 1), RangeRule("l_discount", 0, strict=True), RangeRule("l_tax", 0.01))
DOMAINS = (DomainRule("lang", ("en", "fr", "de")), DomainRule("source", _SOURCES))
NULLS = (NotNullRule("lang"), NotNullRule("quality"))
SCHEMA = (
    NoteRule("redundancy", "language columns", "both kept", "model the recoded one", "for tracing"),
    ForbiddenColumnRule("text"),
    ForbiddenColumnRule("answer"),
)


def _flagged(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with stored flags; ``thousands`` is a count, not a flag."""
    return labelled(spark, sf).withColumns(
        {
            "has_quality": F.col("quality").isNotNull().cast("int"),
            "toxic_missing": F.col("toxic").isNull().cast("int"),
            "thousands": F.floor(F.col("n_chars") / 10000).cast("int"),
        }
    )


FLAGGED = f"""(SELECT *, CASE WHEN quality IS NULL THEN 0 ELSE 1 END AS has_quality,
  CASE WHEN toxic IS NULL THEN 1 ELSE 0 END AS toxic_missing, CAST(floor(n_chars / 10000) AS INTEGER) AS thousands
  FROM {LABELLED})"""


def _row(no: int, block: str, check: str, count: str, action: str, why: str, relation: str) -> str:
    return f"""SELECT {no} AS rule_no, '{block}' AS block, '{check}' AS "check", CAST(v AS VARCHAR) AS result,
      CASE WHEN v = 0 THEN 'no correction' ELSE '{action}' END AS decision, '{why}' AS justification
      FROM (SELECT {count} AS v FROM {relation})"""


def _duplicates_sql(first: int = 1) -> str:
    why = "copies beyond the first are counted"

    def extra(keys: str) -> str:
        return f"(SELECT sum(n - 1)::BIGINT AS x FROM (SELECT count(*) AS n FROM {FLAGGED} GROUP BY {keys}))"

    rows = [
        ("whole row", "ALL", "review duplicates"),
        ("text", "text", "review duplicates"),
        ("lang, quality", "lang, quality", "expected"),
    ]
    parts = []
    for i, (name, keys, action) in enumerate(rows):
        relation = extra("doc_id, text" if keys == "ALL" else keys)
        parts.append(_row(first + i, "duplicates", f"duplicates by {name}", "x", action, why, relation))
    return " UNION ALL ".join(parts)


def _derived_sql(first: int = 1) -> str:
    block, action, why = "derived consistency", "recompute flag", "the stored flag must equal the recomputed one"
    rows = [
        ("has_quality against present quality", "has_quality", "quality IS NOT NULL"),
        ("toxic_missing against missing toxic", "toxic_missing", "toxic IS NULL"),
        ("quality against present lang", "quality", "lang IS NOT NULL"),
    ]
    return " UNION ALL ".join(
        _row(
            first + i, block, check,
            f"count(*) FILTER (WHERE {flag} IS DISTINCT FROM CAST(({test}) AS INTEGER))", action, why, FLAGGED,
        )
        for i, (check, flag, test) in enumerate(rows)
    )


def _levels_sql(no: int, block: str, check: str, column: str, allowed: str, action: str, why: str, relation: str = FLAGGED):
    return f"""SELECT {no} AS rule_no, '{block}' AS block, '{check}' AS "check",
      CAST((SELECT count(DISTINCT {column}) FROM {relation} WHERE {column} NOT IN ({allowed})) AS VARCHAR) AS result,
      CASE WHEN (SELECT count(*) FROM {relation} WHERE {column} NOT IN ({allowed})) = 0 THEN 'no correction'
        ELSE '{action}' END AS decision, '{why}' AS justification"""


def _binary_sql(first: int = 1) -> str:
    return " UNION ALL ".join(
        _levels_sql(
            first + i, "binary coding", f"other values of {c}", c, "0, 1", "review coding", "only 0 and 1 may occur"
        )
        for i, c in enumerate(("quality", "toxic", "thousands"))
    )


_DECLARED = {"lang": "'en', 'fr', 'de'", "source": ", ".join(f"'{s}'" for s in _SOURCES)}


def _domain_sql(first: int = 1) -> str:
    return " UNION ALL ".join(
        _levels_sql(
            first + i, "category levels", f"unexpected levels of {c}", c, allowed, "review recoding",
            "only declared levels may occur",
        )
        for i, (c, allowed) in enumerate(_DECLARED.items())
    )


def _nulls_sql(first: int = 1) -> str:
    return " UNION ALL ".join(
        _row(
            first + i, "category levels", f"missing {c}", f"count(*) - count({c})", "fill or drop",
            "no value may be absent", FLAGGED,
        )
        for i, c in enumerate(("lang", "quality"))
    )


def _schema_sql(first: int = 1) -> str:
    why = "the target is derived from this column"
    return f"""SELECT {first} AS rule_no, 'redundancy' AS block, 'language columns' AS "check", 'both kept' AS result,
        'model the recoded one' AS decision, 'for tracing' AS justification
      UNION ALL SELECT {first + 1}, 'leakage', 'text in the table', 'included', 'drop before modelling', '{why}'
      UNION ALL SELECT {first + 2}, 'leakage', 'answer in the table', 'not included', 'no correction', '{why}'"""


def _ranges_sql(first: int = 1) -> str:
    why = "values beyond the bound are invalid"
    rows = [
        ("l_quantity >= 1", "l_quantity < 1"),
        ("l_discount > 0", "l_discount <= 0"),
        ("l_tax >= 0.01", "l_tax < CAST(0.01 AS DOUBLE)"),
    ]
    return " UNION ALL ".join(
        _row(first + i, "numeric range", check, f"count(*) FILTER (WHERE {bad})", "review range", why, "lineitem")
        for i, (check, bad) in enumerate(rows)
    )


@query("dq_duplicates", _duplicates_sql())
def _(spark: SparkSession, sf: str) -> DataFrame:
    return quality_report(_flagged(spark, sf), DUPLICATES)


@query("dq_derived_consistency", _derived_sql())
def _(spark: SparkSession, sf: str) -> DataFrame:
    return quality_report(_flagged(spark, sf), DERIVED)


@query("dq_binary_domain", _binary_sql())
def _(spark: SparkSession, sf: str) -> DataFrame:
    return quality_report(_flagged(spark, sf), BINARY)


@query("assert_binary", f"SELECT doc_id, quality, toxic FROM {LABELLED}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = labelled(spark, sf).select("doc_id", "quality", "toxic")
    assert_binary(df, ["quality", "toxic"])
    return df


@query("dq_range", _ranges_sql())
def _(spark: SparkSession, sf: str) -> DataFrame:
    return quality_report(table(spark, sf, "lineitem"), RANGES)


@query("dq_category_domain", _domain_sql())
def _(spark: SparkSession, sf: str) -> DataFrame:
    return quality_report(_flagged(spark, sf), DOMAINS)


@query("dq_nulls_after_recode", _nulls_sql())
def _(spark: SparkSession, sf: str) -> DataFrame:
    return quality_report(_flagged(spark, sf), NULLS)


PARTS = (DomainRule("part", ("1", "2", "3")), BinaryRule("l_linenumber"))


@query(
    "dq_levels",
    """SELECT 1 AS rule_no, 'part' AS variable, CAST(l_partkey AS VARCHAR) AS value, count(*) AS n FROM lineitem
      WHERE l_partkey NOT IN (1, 2, 3) GROUP BY l_partkey
      UNION ALL SELECT 2, 'l_linenumber', CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY l_linenumber""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumn("part", F.col("l_partkey").cast("string"))
    return level_report(rows, PARTS)


@query(
    "dq_many_levels",
    _levels_sql(
        1, "category levels", "unexpected levels of part", "l_partkey", "1, 2, 3", "review recoding",
        "only declared levels may occur", "lineitem",
    )
    + " UNION ALL "
    + _levels_sql(
        2, "binary coding", "other values of l_linenumber", "l_linenumber", "0, 1", "review coding",
        "only 0 and 1 may occur", "lineitem",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumn("part", F.col("l_partkey").cast("string"))
    return quality_report(rows, PARTS)


@query(
    "dq_report",
    " UNION ALL ".join(
        [_duplicates_sql(1), _derived_sql(4), _binary_sql(7), _domain_sql(10), _nulls_sql(12), _schema_sql(14), _ranges_sql(17)]
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    documents = (*DUPLICATES, *DERIVED, *BINARY, *DOMAINS, *NULLS, *SCHEMA)
    return joint_report([(_flagged(spark, sf), documents), (table(spark, sf, "lineitem"), RANGES)])


@query("assert_finite", f"SELECT doc_id, {R('score')} AS score FROM {SCORED}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    scored = scored_labels(spark, sf).select("doc_id", "score")
    assert_finite(scored, "score")
    return rounded(scored, "score")


SCHEMA_RULES = (
    ForbiddenColumnRule("text"),
    ForbiddenColumnRule("answer"),
    ForbiddenColumnRule("toxic"),
    TypeRule("n_chars", "bigint"),
    TypeRule("quality", "bigint"),
    TypeRule("answer", "string"),
)


@query(
    "dq_schema_rules",
    f"""WITH rules AS (SELECT * FROM (VALUES ('text', 'absent', NULL, 'drop before modelling'),
        ('answer', 'absent', NULL, 'drop before modelling'), ('toxic', 'absent', NULL, 'drop before modelling'),
        ('n_chars', 'type bigint', 'BIGINT', 'cast before use'), ('quality', 'type bigint', 'BIGINT', 'cast before use'),
        ('answer', 'type string', 'VARCHAR', 'cast before use')) v("column", "check", wanted, "action")),
    kinds AS (SELECT column_name, column_type FROM (DESCRIBE SELECT * FROM {LABELLED})),
    counted AS (SELECT count("text") AS t, count(toxic) AS x, count(n_chars) AS n, count(quality) AS q FROM {LABELLED})
    SELECT "column", "check", CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string'
        ELSE 'missing' END AS found,
      CASE "column" WHEN 'text' THEN t WHEN 'toxic' THEN x WHEN 'n_chars' THEN n WHEN 'quality' THEN q ELSE 0 END AS n_values,
      CASE WHEN (wanted IS NULL AND column_type IS NULL) OR column_type = wanted THEN '{NO_ACTION}' ELSE "action" END AS decision
    FROM rules LEFT JOIN kinds ON "column" = column_name, counted""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return schema_report(labelled(spark, sf), SCHEMA_RULES)
