"""Data-quality rules: declared as a list, compiled into few scans, reported in one long table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.functions.text import key_digest
from tabscope.operators.columns import missing, present, require_columns, union_reports, value_of
from tabscope.operators.profile import levels_long, plain_value, stack_row
from tabscope.session import stage

REPORT_COLUMNS = ("rule_no", "block", "check", "result", "decision", "justification")
NO_ACTION = "no correction"
REPORT_SCHEMA = "rule_no int, block string, check string, result string, decision string, justification string"


@dataclass(frozen=True)
class DuplicateRule:
    """Extra copies of the whole row (``keys`` empty) or of a key."""

    keys: tuple[str, ...] = ()
    action: str = "review duplicates"


@dataclass(frozen=True)
class DerivedFlagRule:
    """A stored 0/1 flag must equal the presence (or absence) of its source column."""

    flag: str
    source: str
    when_present: bool = True
    action: str = "recompute flag"


@dataclass(frozen=True)
class BinaryRule:
    """Only 0 and 1 may occur; the report counts the other values, ``level_report`` lists all."""

    column: str
    action: str = "review coding"


@dataclass(frozen=True)
class RangeRule:
    """Values must lie above ``bound`` (``strict``) or not below it."""

    column: str
    bound: float
    strict: bool = False
    action: str = "review range"


@dataclass(frozen=True)
class DomainRule:
    """Only declared levels may occur; the report counts the others, ``level_report`` lists them."""

    column: str
    allowed: tuple[str, ...]
    action: str = "review recoding"


@dataclass(frozen=True)
class NotNullRule:
    column: str
    action: str = "fill or drop"


@dataclass(frozen=True)
class ForbiddenColumnRule:
    """A column that must not reach the model, for example one the target was derived from."""

    column: str
    action: str = "drop before modelling"


@dataclass(frozen=True)
class TypeRule:
    """A column that must be there with a given type, as Spark names it."""

    column: str
    kind: str
    action: str = "cast before use"


@dataclass(frozen=True)
class NoteRule:
    """A constant row that documents a decision."""

    block: str
    check: str
    result: str
    decision: str
    justification: str


Rule = (
    DuplicateRule | DerivedFlagRule | BinaryRule | RangeRule | DomainRule | NotNullRule | ForbiddenColumnRule | NoteRule
)


def _counted(df: DataFrame, rule: Rule) -> tuple[str, str, Column, str] | None:
    """(block, check, violating rows, justification) of a rule that one aggregate can answer."""
    match rule:
        case DerivedFlagRule(flag, source, when_present):
            value = value_of(df, source)
            recomputed = present(value) if when_present else missing(value)
            state = "present" if when_present else "missing"
            return (
                "derived consistency",
                f"{flag} against {state} {source}",
                F.count_if(~F.col(flag).eqNullSafe(recomputed)),
                "the stored flag must equal the recomputed one",
            )
        case RangeRule(column, bound, strict):
            value = value_of(df, column)
            return (
                "numeric range",
                f"{column} {'>' if strict else '>='} {bound:g}",
                F.count_if(value <= bound if strict else value < bound),
                "values beyond the bound are invalid",
            )
        case NotNullRule(column):
            absent = F.count_if(value_of(df, column).isNull())
            return ("category levels", f"missing {column}", absent, "no value may be absent")
        case BinaryRule(column):
            violations = F.count_if(~value_of(df, column).isin(0, 1))
            return "binary coding", f"other values of {column}", violations, "only 0 and 1 may occur"
        case DomainRule(column, allowed):
            violations = F.count_if(~value_of(df, column).isin(*allowed))
            return "category levels", f"unexpected levels of {column}", violations, "only declared levels may occur"
    return None


def _columns(rule: Rule) -> list[str]:
    match rule:
        case DuplicateRule(keys):
            return list(keys)
        case DerivedFlagRule(flag, source):
            return [flag, source]
        case BinaryRule(column) | RangeRule(column) | DomainRule(column) | NotNullRule(column):
            return [column]
    return []


def _verdict(violations: Column, action: str) -> Column:
    return F.when(violations == 0, F.lit(NO_ACTION)).otherwise(F.lit(action))


def _same(keys: Sequence[str]) -> str:
    """Name of the column that identifies rows with equal ``keys`` (none: equal rows)."""
    return f"__same({', '.join(keys)})"


def rule_columns(df: DataFrame, rules: Sequence[Rule], also: Sequence[str] = ()) -> DataFrame:
    """The columns that the rules and ``also`` read, and a short digest for the keys of each duplicate rule.

    Missing values are equal to each other, and long texts leave as digests.
    """
    digested = [rule for rule in rules if isinstance(rule, DuplicateRule) and _same(rule.keys) in df.columns]
    require_columns(df, sorted({name for rule in rules if rule not in digested for name in _columns(rule)}))
    compared = [rule.keys for rule in rules if isinstance(rule, DuplicateRule)]
    named = [name for rule in rules if not isinstance(rule, DuplicateRule) for name in _columns(rule)]
    digests = []
    for keys in dict.fromkeys(compared):
        if _same(keys) in df.columns:
            digests.append(F.col(f"`{_same(keys)}`"))
            continue
        parts = [plain_value(df, name).alias(name) for name in keys or df.columns]
        digests.append(key_digest(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})).alias(_same(keys)))
    return df.select(*[F.col(f"`{name}`") for name in dict.fromkeys([*also, *named])], *digests)


def unexpected_values(df: DataFrame, domains: Mapping[str, Sequence]) -> DataFrame:
    """Every observed level outside its declared domain, with its row count."""
    require_columns(df, list(domains))
    return (
        _outside_domains(df, domains)
        .groupBy("variable", "value")
        .agg(F.count("*").alias("n"))
    )


def _outside_domains(df: DataFrame, domains: Mapping[str, Sequence]) -> DataFrame:
    columns = list(domains)
    blanked = df.select(
        *[F.when(~F.col(name).isin(*domains[name]), F.col(name)).cast("string").alias(name) for name in columns]
    )
    return levels_long(blanked, columns)


def _shown_levels(df: DataFrame, numbered: Sequence[tuple[int, Rule]]) -> DataFrame:
    """(variable, value) rows, the variable being a rule number: all values for binary rules, others for domains."""
    shown = []
    for no, rule in numbered:
        value = value_of(df, rule.column)
        if isinstance(rule, DomainRule):
            value = F.when(~value.isin(*rule.allowed), value)
        shown.append(value.alias(str(no)))
    return levels_long(df.select(*shown), [str(no) for no, _ in numbered])


def _numbered_levels(rules: Sequence[Rule], first_no: int) -> list[tuple[int, Rule]]:
    return [(no, rule) for no, rule in enumerate(rules, first_no) if isinstance(rule, BinaryRule | DomainRule)]


def level_report(df: DataFrame, rules: Sequence[Rule], first_no: int = 1) -> DataFrame:
    """The levels behind the level rules: rule_no, variable, value and its rows, one row per level, however many."""
    numbered = _numbered_levels(rules, first_no)
    if not numbered:
        return df.sparkSession.createDataFrame([], "rule_no int, variable string, value string, n long")
    named = {str(no): rule.column for no, rule in numbered}
    column = F.element_at(F.create_map(*[F.lit(x) for pair in named.items() for x in pair]), F.col("variable"))
    counted = _shown_levels(df, numbered).groupBy("variable", "value").agg(F.count("*").alias("n"))
    return counted.select(F.col("variable").cast("int").alias("rule_no"), column.alias("variable"), "value", "n")


def quality_report(
    df: DataFrame, rules: Sequence[Rule], first_no: int = 1, columns: Sequence[str] | None = None
) -> DataFrame:
    """Check all ``rules`` on ``df``: one row each, numbered in the order given.

    ``df`` is read once: the columns in question are written with short digests of duplicate keys, where more than one
    pass needs them. One aggregate counts the violations of every scalar and level rule, one distinct the levels that
    level rules object to, and one grouping serves all duplicate rules. ``columns`` are those of the table under
    judgement, if ``df`` is already a narrow form of it.
    """
    numbered = list(enumerate(rules, start=first_no))
    known = list(columns or df.columns)
    narrow = rule_columns(df, rules)
    checked = [(no, rule, found) for no, rule in numbered if (found := _counted(narrow, rule)) is not None]
    levels = _numbered_levels(rules, first_no)
    repeated = [(no, rule) for no, rule in numbered if isinstance(rule, DuplicateRule)]
    if sum(map(bool, (checked, levels, repeated))) > 1:
        narrow = stage(narrow, "rules")
    parts: list[DataFrame] = []

    if checked:
        counts = narrow.agg(*[violations.alias(f"v{no}") for no, _, (_, _, violations, _) in checked])
        entries = []
        for no, rule, (block, check, _, why) in checked:
            found = F.col(f"v{no}")
            result = F.lit(None).cast("string") if isinstance(rule, BinaryRule | DomainRule) else found.cast("string")
            entries.append((F.lit(no), F.lit(block), F.lit(check), result, _verdict(found, rule.action), F.lit(why)))
        rows = stack_row(counts, entries, REPORT_COLUMNS)
        if levels:
            others = _shown_levels(narrow, levels).distinct()
            binary = [str(no) for no, rule in levels if isinstance(rule, BinaryRule)]
            others = others.where(~(F.col("variable").isin(*binary) & F.col("value").try_cast("double").isin(0, 1)))
            counted = others.groupBy(F.col("variable").cast("int").alias("rule_no")).agg(F.count("*").alias("__levels"))
            numbers = F.when(F.col("rule_no").isin(*[no for no, _ in levels]), F.coalesce("__levels", F.lit(0)))
            rows = rows.join(F.broadcast(counted), "rule_no", "left").withColumn(
                "result", F.coalesce("result", numbers.cast("string"))
            )
        parts.append(rows.select(*REPORT_COLUMNS))

    if repeated:
        keyed = [F.struct(F.lit(no).alias("rule_no"), F.col(f"`{_same(rule.keys)}`").alias("k")) for no, rule in repeated]
        copies = narrow.select(F.inline(F.array(*keyed))).groupBy("rule_no", "k").agg(F.count("*").alias("n"))
        extra = copies.groupBy("rule_no").agg(F.sum(F.col("n") - 1).alias("extra"))
        named = df.sparkSession.createDataFrame(
            [(no, f"duplicates by {', '.join(rule.keys) or 'whole row'}", rule.action) for no, rule in repeated],
            "rule_no int, check string, action string",
        )
        found = named.join(F.broadcast(extra), "rule_no", "left").withColumn("extra", F.coalesce("extra", F.lit(0)))
        parts.append(
            found.select(
                "rule_no",
                F.lit("duplicates").alias("block"),
                "check",
                F.col("extra").cast("string").alias("result"),
                F.when(F.col("extra") == 0, F.lit(NO_ACTION)).otherwise(F.col("action")).alias("decision"),
                F.lit("copies beyond the first are counted").alias("justification"),
            )
        )

    constant = []
    for no, rule in numbered:
        if isinstance(rule, NoteRule):
            constant.append((no, rule.block, rule.check, rule.result, rule.decision, rule.justification))
        elif isinstance(rule, ForbiddenColumnRule):
            included = rule.column in known
            constant.append(
                (
                    no, "leakage", f"{rule.column} in the table", "included" if included else "not included",
                    rule.action if included else NO_ACTION, "the target is derived from this column",
                )
            )
    if constant:
        parts.append(df.sparkSession.createDataFrame(constant, REPORT_SCHEMA))
    return union_reports(*parts)


def schema_report(df: DataFrame, rules: Sequence[ForbiddenColumnRule | TypeRule]) -> DataFrame:
    """A row per rule on the columns: column, check, found (its type, or 'missing'), n_values present, decision.

    All present values are counted by one aggregate, which reads only the columns in question: a forbidden column
    that is there but empty can be told from one that leaks, a column of the right type from one without any value.
    """
    kinds = dict(df.dtypes)
    columns = list(dict.fromkeys(rule.column for rule in rules if rule.column in kinds))
    counted = [F.count(value_of(df, name)).alias(f"n{i}") for i, name in enumerate(columns)]
    counts = df.agg(*counted, F.count("*").alias("rows"))
    entries = []
    for rule in rules:
        found = kinds.get(rule.column, "missing")
        forbidden = isinstance(rule, ForbiddenColumnRule)
        broken = found != "missing" if forbidden else found != rule.kind
        n = F.col(f"n{columns.index(rule.column)}") if rule.column in kinds else F.lit(0).cast("long")
        check = "absent" if forbidden else f"type {rule.kind}"
        entries.append((F.lit(rule.column), F.lit(check), F.lit(found), n, F.lit(rule.action if broken else NO_ACTION)))
    return stack_row(counts, entries, ("column", "check", "found", "n_values", "decision"))


Checks = Sequence[tuple[DataFrame, Sequence[Rule]] | tuple[DataFrame, Sequence[Rule], Sequence[str]]]


def joint_report(tables: Checks) -> DataFrame:
    """One report over several tables (with rules, and the columns under judgement if they are others), sorted by number."""
    reports, first_no = [], 1
    for df, rules, *columns in tables:
        reports.append(quality_report(df, rules, first_no, *columns))
        first_no += len(rules)
    return union_reports(*reports).orderBy("rule_no")


def joint_levels(tables: Checks) -> DataFrame:
    """``level_report`` over several tables, with the numbers of ``joint_report``."""
    reports, first_no = [], 1
    for df, rules, *_ in tables:
        reports.append(level_report(df, rules, first_no))
        first_no += len(rules)
    return union_reports(*reports)


def assert_binary(df: DataFrame, columns: Sequence[str]) -> None:
    """Fail when a column holds a present value other than 0 and 1; every offending column is named."""
    require_columns(df, columns)
    row = df.agg(*[F.count_if(~F.col(name).isin(0, 1)).alias(name) for name in columns]).first()
    offending = {name: row[name] for name in columns if row[name]}
    if offending:
        raise ValueError(f"binary columns with values other than 0 and 1 (rows): {offending}")


def assert_finite(df: DataFrame, column: str) -> None:
    """Fail when a score is missing, NaN or infinite."""
    score = F.col(column).cast("double")
    row = df.agg(F.count_if(score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))).alias("bad")).first()
    if row["bad"]:
        raise ValueError(f"{column} holds {row['bad']} values that are not finite")
