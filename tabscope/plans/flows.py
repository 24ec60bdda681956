"""The five analysis stages, each configured by names and rule lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.functions.numbers import age_from_year, coerce_numeric, rate_per, strict_numeric
from tabscope.functions.recode import RecodeRule, collapse_levels, recode
from tabscope.functions.text import normalize_key, zero_pad_code
from tabscope.operators.clusters import (
    best_k,
    cluster_assignments,
    cluster_profile,
    kmeans_sweep,
    pca_2d,
)
from tabscope.operators.columns import cast_columns, missing, present, select_required, union_reports, value_of
from tabscope.operators.contingency import (
    chi_square_test,
    contingency_percent,
    contingency_table,
    expected_frequencies,
    result_comments,
)
from tabscope.operators.features import feature_names, fit_encoder, level_index
from tabscope.operators.impute import clean_stage
from tabscope.operators.joins import enrich_left_join, lookup_join, measured_bytes
from tabscope.operators.metrics import classification_metrics, confusion_matrix
from tabscope.operators.models import coefficient_table, logistic_fit, logistic_score
from tabscope.operators.order_stats import ColumnSummary, summarize_columns
from tabscope.operators.profile import QUARTILES, distribution_bundle, iqr_summary, observed_columns
from tabscope.operators.quality import Rule, assert_binary, assert_finite, joint_levels, joint_report, rule_columns
from tabscope.operators.split import parts, split_summary, stratified_split
from tabscope.session import stage


@dataclass(frozen=True)
class IntegrateSpec:
    """How a fact table is derived and enriched.

    ``key`` is normalised on both sides before the join; ``counted`` is counted per key; ``rates`` maps an output
    name to (count column, base column).
    """

    key: str
    dim_key: str
    counted: str
    count_name: str
    match_flag: str
    match_source: str
    pad: Mapping[str, int] = field(default_factory=dict)
    present_flags: Mapping[str, str] = field(default_factory=dict)
    missing_flags: Mapping[str, str] = field(default_factory=dict)
    year: tuple[str, str, str] | None = None
    reference_year: int = 2026
    rates: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    spread_by: Sequence[str] | None = None
    articles: Sequence[str] = ()


def integrate_flow(fact: DataFrame, dim: DataFrame, spec: IntegrateSpec) -> DataFrame:
    """Derive flags, ages and per-key counts, then enrich by the normalised key.

    The fact is grouped by its raw names, and only these are normalised; their counts are summed per key and joined to
    the dimension. That small table is written once and looked up by raw name, so the fact is read twice and never
    normalised row by row.
    """
    derived = {
        **{name: zero_pad_code(F.col(name), width) for name, width in spec.pad.items()},
        **{flag: present(value_of(fact, source)) for flag, source in spec.present_flags.items()},
        **{flag: missing(value_of(fact, source)) for flag, source in spec.missing_flags.items()},
    }
    raw = fact.groupBy(F.col(spec.key).alias("__raw")).agg(F.count(spec.counted).alias("__n"))
    names = stage(raw.withColumn("__key", normalize_key(F.col("__raw"), spec.articles)), "names")
    counts = names.groupBy("__key").agg(F.sum("__n").alias(spec.count_name))
    keyed = dim.withColumn("__key", normalize_key(F.col(spec.dim_key), spec.articles))
    known = lookup_join(names.drop("__n"), counts, ["__key"], measured_bytes(counts), null_safe=True)
    known = enrich_left_join(known, keyed, ["__key"], spec.match_flag, spec.match_source).drop("__key")
    shared = [name for name in known.columns if name in fact.columns]
    if shared:
        raise ValueError(f"columns of the dimension that the fact also has: {shared}")
    known = stage(known, "known-names")
    base = fact.withColumns(derived)
    if spec.year is not None:
        source, year_name, age_name = spec.year
        base = base.withColumn(year_name, coerce_numeric(F.col(source).cast("string")))
        base = base.withColumn(age_name, age_from_year(F.col(year_name), spec.reference_year))
    base = base.withColumn("__raw", F.col(spec.key))
    joined = lookup_join(base, known, ["__raw"], measured_bytes(known), spec.spread_by, null_safe=True)
    rates = {name: rate_per(F.col(count), F.col(over)) for name, (count, over) in spec.rates.items()}
    return joined.withColumns(rates).drop("__raw")


@dataclass(frozen=True)
class CleanSpec:
    """What the cleaning stage keeps, fills, types, recodes and checks."""

    columns: Sequence[str]
    impute: Sequence[str]
    distinct_medians: Sequence[str]
    binary: Sequence[str]
    numeric: Sequence[str]
    recodes: Mapping[str, tuple[str, Sequence[RecodeRule], str]]
    rules: Sequence[Rule] = ()
    source_rules: Sequence[Rule] = ()
    suffix: str = "_imputed"


@dataclass(frozen=True)
class CleanResult:
    """The cleaned table and the medians used; the reports are made when they are first asked for."""

    table: DataFrame
    medians: dict[str, float | None]
    source: DataFrame
    source_columns: Sequence[str]
    spec: CleanSpec

    @cached_property
    def _summaries(self) -> dict[str, ColumnSummary]:
        observed = observed_columns(self.table, self.spec.numeric, self.spec.suffix)
        return summarize_columns(observed, self.spec.numeric, QUARTILES)

    @cached_property
    def outliers(self) -> DataFrame:
        return iqr_summary(self.table, self.spec.numeric, self.spec.suffix, self._summaries)

    @cached_property
    def distributions(self) -> dict[str, DataFrame]:
        return distribution_bundle(self.table, self.spec.numeric, self.spec.suffix, self._summaries)

    @property
    def _checks(self) -> list[tuple[DataFrame, Sequence[Rule], Sequence[str]]]:
        checks = [(self.source, self.spec.source_rules, self.source_columns)]
        checks.append((self.table, self.spec.rules, self.table.columns))
        return [check for check in checks if check[1]]

    @cached_property
    def report(self) -> DataFrame | None:
        return joint_report(self._checks) if self._checks else None

    @cached_property
    def levels(self) -> DataFrame | None:
        """The levels behind the report's level rules, one row each."""
        return joint_levels(self._checks) if self._checks else None


def cleaning_flow(integrated: DataFrame, spec: CleanSpec) -> CleanResult:
    """Select, impute, type and recode; outliers, distributions and rules are checked on demand.

    Only the columns that the settings name are written (with a digest of the whole row where a rule compares rows),
    once before the fill and once after it, as medians, summaries and rules each scan a few of them.
    """
    source = stage(rule_columns(integrated, spec.source_rules, spec.columns), "integrated")
    base = select_required(source, spec.columns)
    clean, medians = clean_stage(base, spec.impute, spec.distinct_medians, spec.suffix)
    assert_binary(clean, spec.binary)
    typed = cast_columns(clean, {name: "int" for name in spec.binary})
    texts = dict(typed.dtypes)
    typed = typed.withColumns(
        {name: strict_numeric(F.col(name)) for name in spec.numeric if texts[name] == "string"}
    )
    typed = typed.withColumns(
        {name: recode(F.col(source), rules, default) for name, (source, rules, default) in spec.recodes.items()}
    )
    return CleanResult(stage(typed, "typed"), medians, source, integrated.columns, spec)


@dataclass(frozen=True)
class ModelSpec:
    """Key, target and features shared by the supervised and the clustering stage."""

    key: str
    target: str
    numeric: Sequence[str]
    binary: Sequence[str]
    categorical: Sequence[str]


def supervised_flow(
    typed: DataFrame, spec: ModelSpec, test_size: float = 0.3, seed: int = 42, penalize_intercept: bool = True
) -> dict[str, DataFrame]:
    """Split, encode, fit, score and evaluate; levels are learned before the split, scales on the training part.

    ``typed`` should be a stored table, such as the cleaning stage returns: it is scanned several times.
    """
    columns = [spec.key, spec.target, *spec.numeric, *spec.binary, *spec.categorical]
    table = select_required(typed, columns).withColumn(spec.target, F.col(spec.target).cast("int"))
    levels = level_index(table, spec.categorical)
    split = stratified_split(table, spec.target, spec.key, test_size, seed)
    train, test = parts(split)
    encoder = fit_encoder(train, spec.numeric, spec.binary, spec.categorical, drop_first=True, levels=levels)
    model = logistic_fit(train, spec.target, encoder, penalize_intercept)
    scored = logistic_score(test, model, [spec.key, spec.target])
    assert_finite(scored, "probability")
    return {
        "metrics": classification_metrics(scored, spec.target, "prediction", "probability"),
        "confusion": confusion_matrix(scored, spec.target, "prediction"),
        "coefficients": coefficient_table(typed.sparkSession, model),
        "split": split_summary(split, spec.target),
        "scores": scored,
    }


def clustering_flow(
    typed: DataFrame,
    spec: ModelSpec,
    k_min: int = 2,
    k_max: int = 6,
    n_init: int = 20,
    seed: int = 42,
    flags: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """Encode every level, sweep k, keep the best model and describe its groups. The target only describes.

    ``typed`` should be a stored table; the encoded matrix is staged for the sweep.
    """
    encoder = fit_encoder(typed, spec.numeric, spec.binary, spec.categorical)
    kept = list(dict.fromkeys([spec.key, spec.target, *flags, *spec.numeric, *spec.categorical]))
    matrix = stage(encoder.assemble(typed, keep=kept), "matrix")
    sweep = kmeans_sweep(matrix, k_min, k_max, n_init, seed)
    chosen = best_k(sweep.scores)
    model = sweep.models[chosen.first()["k"]]
    labelled = model.transform(matrix)
    return {
        "k_scores": sweep.scores,
        "best_k": chosen,
        "profile": cluster_profile(labelled, "cluster", [spec.target, *flags], spec.numeric, spec.categorical),
        "assignments": cluster_assignments(matrix, model, spec.key, [spec.target, *spec.categorical]),
        "features": feature_names(typed.sparkSession, encoder),
        "pca": pca_2d(labelled, keep=(spec.key, "cluster")),
    }


def association_flow(
    typed: DataFrame, rows: str, target: str, keep: Sequence[str], other: str, collapsed: str
) -> dict[str, DataFrame]:
    """Test the original levels, merge the rare ones, test again."""
    grouped = typed.withColumn(collapsed, collapse_levels(F.col(rows), keep, other))
    tables: dict[str, DataFrame] = {}
    comments = []
    for suffix, df, variable in (("original", typed, rows), ("collapsed", grouped, collapsed)):
        result = chi_square_test(df, variable, target)
        tables[f"table_{suffix}"] = contingency_table(df, variable, target)
        tables[f"percent_{suffix}"] = contingency_percent(df, variable, target)
        tables[f"expected_{suffix}"] = expected_frequencies(df, variable, target)
        tables[f"result_{suffix}"] = result
        comments.append(result_comments(result))
    tables["comments"] = union_reports(*comments)
    return tables
