"""Contingency tests, splits, encoding, metrics, models, clusters and the analysis flows."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.functions.numbers import assumption_label, band_label, decision_label
from tabscope.functions.recode import collapse_levels
from tabscope.functions.stats import cramers_v
from tabscope.operators.clusters import (
    ClusterModel,
    best_k,
    cluster_assignments,
    cluster_bars,
    cluster_profile,
    inertia,
    kmeans_fit,
    kmeans_sweep,
    pca_2d,
    pca_scaled,
    silhouette,
)
from tabscope.operators.columns import union_reports
from tabscope.operators.contingency import (
    association_bars,
    chi_square_test,
    contingency_percent,
    contingency_table,
    expected_frequencies,
)
from tabscope.operators.features import feature_names, fit_encoder, one_hot, standardize
from tabscope.operators.joins import group_count_broadcast
from tabscope.operators.metrics import classification_metrics, confusion_matrix, confusion_shares, roc_auc
from tabscope.operators.models import LogisticModel, coefficient_table, logistic_fit, logistic_score
from tabscope.operators.profile import stack_row
from tabscope.operators.silhouettes import euclidean_silhouette
from tabscope.operators.split import hash_split, split_summary, stratified_split
from tabscope.plans.flows import ModelSpec, association_flow, clustering_flow, supervised_flow
from tabscope.session import stage
from workload.base import (
    LABELLED,
    PCT,
    R,
    SCORED,
    chi_square_sql,
    contingency_sql,
    labelled,
    query,
    r6,
    rounded,
    scored_labels,
    table,
)

COLLAPSED = "CASE WHEN lang IN ('en', 'fr') THEN lang ELSE 'other' END"


def _grouped(spark: SparkSession, sf: str) -> DataFrame:
    group = collapse_levels(F.col("lang"), ["en", "fr"], "other")
    return labelled(spark, sf).withColumn("lang_group", group)


# -- association -------------------------------------------------------------------------------------------------


@query("contingency_table", f"SELECT level AS lang, n_negative, n_positive FROM {contingency_sql('lang', LABELLED)}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return contingency_table(labelled(spark, sf), "lang", "quality")


def _percent_sql(name: str, rows: str) -> str:
    return f"""SELECT level AS {name}, n_total, n_negative, n_positive, {PCT("n_negative", "n_total")} AS pct_negative,
      {PCT("n_positive", "n_total")} AS pct_positive FROM {contingency_sql(rows, LABELLED)}"""


@query("contingency_percent", _percent_sql("lang", "lang"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return contingency_percent(labelled(spark, sf), "lang", "quality")


@query("association_bars", _percent_sql("source", "source"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return association_bars(labelled(spark, sf), "source", "quality")


def _expected_sql(name: str, rows: str) -> str:
    e = {side: f"CAST(n_total AS DOUBLE) * (sum({side}) OVER ()) / (sum(n_total) OVER ())" for side in ("n_negative", "n_positive")}
    return f"""SELECT level AS {name}, {R(e["n_negative"])} AS expected_negative, {R(e["n_positive"])} AS expected_positive
      FROM {contingency_sql(rows, LABELLED)}"""


@query("expected_frequencies", _expected_sql("lang", "lang"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = expected_frequencies(labelled(spark, sf), "lang", "quality")
    return rounded(found, "expected_negative", "expected_positive")


_CHI = ("chi2", "p_value", "cramers_v", "min_expected")
_COLLAPSED_SQL = chi_square_sql("lang_group", COLLAPSED, LABELLED)


@query("flagship_association", _COLLAPSED_SQL)
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Is label quality independent of the (collapsed) language?"""
    return rounded(chi_square_test(_grouped(spark, sf), "lang_group", "quality"), *_CHI)


@query(
    "chi_square_test",
    " UNION ALL ".join(
        (
            chi_square_sql("lang", "lang", LABELLED),
            chi_square_sql("source", "source", LABELLED),
            chi_square_sql("toxic", "toxic", LABELLED),
        )
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    tests = [chi_square_test(labelled(spark, sf), rows, "quality") for rows in ("lang", "source", "toxic")]
    return rounded(union_reports(*tests), *_CHI)


_TESTS = " UNION ALL ".join(chi_square_sql(name, name, LABELLED) for name in ("lang", "source", "toxic"))


def _tests(spark: SparkSession, sf: str) -> DataFrame:
    return union_reports(*[chi_square_test(labelled(spark, sf), rows, "quality") for rows in ("lang", "source", "toxic")])


@query("cramers_v", f"SELECT row_variable, cramers_v AS v, strength FROM ({_TESTS})")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """From the statistics of the tests, with the rows and classes that went into them."""
    counts = [
        contingency_table(labelled(spark, sf), rows, "quality").agg(
            F.lit(rows).alias("row_variable"),
            F.sum(F.col("n_negative") + F.col("n_positive")).alias("n"),
            F.count("*").alias("levels"),
        )
        for rows in ("lang", "source", "toxic")
    ]
    found = _tests(spark, sf).select("row_variable", "chi2").join(union_reports(*counts), "row_variable")
    v = cramers_v(F.col("chi2"), F.col("n"), F.col("levels"), F.lit(2))
    return rounded(found.select("row_variable", v.alias("v"), band_label(v).alias("strength")), "v")


@query("decision_label", f"SELECT row_variable, decision, assumption FROM ({_TESTS})")
def _(spark: SparkSession, sf: str) -> DataFrame:
    decision, assumption = decision_label(F.col("p_value")), assumption_label(F.col("cells_below_5"))
    return _tests(spark, sf).select("row_variable", decision.alias("decision"), assumption.alias("assumption"))


# -- splits ------------------------------------------------------------------------------------------------------


@query(
    "split_summary",
    """SELECT CASE WHEN substr(md5(doc_id || '_42'), 1, 8) < '4ccccccc' THEN 'test' ELSE 'train' END AS split,
      count(*) AS n_rows, count(*) FILTER (WHERE quality = 1) AS n_positive, count(*) FILTER (WHERE quality = 0) AS n_negative
      FROM labels GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return split_summary(hash_split(table(spark, sf, "labels"), "doc_id"), "quality")


@query(
    "stratified_split",
    """WITH classes AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality),
      shares AS (SELECT quality, n, CAST(n AS DOUBLE) / (sum(n) OVER ()) * (sum(n) OVER () - ceil((sum(n) OVER ()) * CAST(0.3 AS DOUBLE)))
        AS share, sum(n) OVER () - ceil((sum(n) OVER ()) * CAST(0.3 AS DOUBLE)) AS n_train FROM classes),
      quotas AS (SELECT quality, n - floor(share) - CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, quality)
        <= n_train - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS n_test FROM shares)
      SELECT l.doc_id, l.quality, CASE WHEN l.place <= q.n_test THEN 'test' ELSE 'train' END AS split
      FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || '_42')) AS place FROM labels) l
      JOIN quotas q ON l.quality = q.quality""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stratified_split(table(spark, sf, "labels"), "quality", "doc_id").select("doc_id", "quality", "split")


# -- encoding ----------------------------------------------------------------------------------------------------

_LANGS = ("de", "en", "es", "fr")


@query(
    "standardize",
    f"""SELECT doc_id, {R("(n_chars - m) / s")} AS n_chars_z FROM documents,
      (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM documents)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    scaled = standardize(table(spark, sf, "documents"), ["n_chars"])
    return rounded(scaled.select("doc_id", "n_chars_z"), "n_chars_z")


def _flags_sql(levels: tuple[str, ...]) -> str:
    return ", ".join(f"CASE WHEN lang = '{level}' THEN 1 ELSE 0 END AS lang_{level}" for level in levels)


@query("one_hot", f"SELECT doc_id, {_flags_sql(_LANGS)} FROM documents")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return one_hot(table(spark, sf, "documents"), ["lang"], ["doc_id"])


@query("one_hot_drop_first", f"SELECT doc_id, {_flags_sql(_LANGS[1:])} FROM documents")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return one_hot(table(spark, sf, "documents"), ["lang"], ["doc_id"], drop_first=True)


def _labelled_only(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with the number of documents of their source, stored for the passes that follow."""
    known = labelled(spark, sf).drop("text").where(F.col("quality").isNotNull())
    return stage(group_count_broadcast(known, ["source"], "doc_id", "in_source"), "labelled")


@query(
    "assemble_features",
    f"""SELECT doc_id, {R("(n_chars - m) / s")} AS f0, CAST(toxic AS DOUBLE) AS f1,
      {", ".join(f"CAST(CASE WHEN lang = '{level}' THEN 1 ELSE 0 END AS DOUBLE) AS f{i + 2}" for i, level in enumerate(_LANGS))}
      FROM {LABELLED}, (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM {LABELLED} WHERE quality IS NOT NULL)
      WHERE quality IS NOT NULL""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    known = labelled(spark, sf).where(F.col("quality").isNotNull())
    encoder = fit_encoder(known, ["n_chars"], ["toxic"], ["lang"])
    slots = vector_to_array(F.col("features"))
    vectors = encoder.assemble(known, ["doc_id"])
    flat = vectors.select("doc_id", *[slots[i].alias(f"f{i}") for i in range(encoder.width)])
    return rounded(flat, "f0")


@query(
    "feature_names",
    """SELECT 0 AS position, 'num__n_chars' AS feature UNION ALL SELECT CAST(row_number() OVER (ORDER BY variable, level) AS INTEGER),
      'cat__' || variable || '_' || level FROM (SELECT DISTINCT 'lang' AS variable, lang AS level FROM documents
      UNION ALL SELECT DISTINCT 'source', source FROM documents)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    encoder = fit_encoder(table(spark, sf, "documents"), ["n_chars"], [], ["lang", "source"])
    return feature_names(spark, encoder)


@query(
    "one_hot_many_levels",
    """SELECT 'cat__l_partkey_' || CAST(l_partkey AS VARCHAR) AS feature, CAST(count(*) AS DOUBLE) AS n_rows FROM lineitem
      GROUP BY l_partkey""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per feature of an encoding with thousands of levels: the sums of its sparse vectors."""
    rows = table(spark, sf, "lineitem").select("l_partkey")
    encoder = fit_encoder(rows, categorical=["l_partkey"])
    sums = encoder.assemble(rows).agg(vector_to_array(Summarizer.sum(F.col("features"))).alias("sums"))
    placed = sums.select(F.posexplode("sums").alias("position", "n_rows"))
    return feature_names(spark, encoder).join(placed, "position").select("feature", "n_rows")


# -- metrics -----------------------------------------------------------------------------------------------------

_CELLS = f"""(SELECT count(*) FILTER (WHERE quality = 0 AND prediction = 0) AS tn,
  count(*) FILTER (WHERE quality = 0 AND prediction = 1) AS fp, count(*) FILTER (WHERE quality = 1 AND prediction = 0) AS fn,
  count(*) FILTER (WHERE quality = 1 AND prediction = 1) AS tp FROM {SCORED})"""

_AUC = f"""SELECT (sum(place) FILTER (WHERE quality = 1) - p * (p + 1) / 2.0) / (p * n) AS value FROM (
  SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS place,
    CAST(count(*) FILTER (WHERE quality = 1) OVER () AS DOUBLE) AS p,
    CAST(count(*) FILTER (WHERE quality = 0) OVER () AS DOUBLE) AS n FROM {SCORED}) GROUP BY p, n"""


@query(
    "confusion_matrix",
    f"""SELECT 0 AS "real", tn AS predicted_0, fp AS predicted_1 FROM {_CELLS}
      UNION ALL SELECT 1, fn, tp FROM {_CELLS}""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return confusion_matrix(scored_labels(spark, sf), "quality", "prediction")


@query(
    "confusion_shares",
    " UNION ALL ".join(
        f"""SELECT {real} AS "real", {said} AS predicted, {cell} AS n,
          {R(f"CAST({cell} AS DOUBLE) / greatest(tn, fp, fn, tp, 1)")} AS share FROM {_CELLS}"""
        for cell, real, said in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(confusion_shares(scored_labels(spark, sf), "quality", "prediction"), "share")


@query(
    "classification_metrics",
    f"""SELECT metric, {R("value")} AS value FROM (
      SELECT 'accuracy' AS metric, CAST(tn + tp AS DOUBLE) / (tn + fp + fn + tp) AS value FROM {_CELLS}
      UNION ALL SELECT 'precision_macro', (coalesce(CAST(tn AS DOUBLE) / nullif(tn + fn, 0), 0)
        + coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0)) / 2 FROM {_CELLS}
      UNION ALL SELECT 'recall_macro', (CAST(tn AS DOUBLE) / (tn + fp) + CAST(tp AS DOUBLE) / (tp + fn)) / 2 FROM {_CELLS}
      UNION ALL SELECT 'f1_macro', (CAST(2 * tn AS DOUBLE) / (2 * tn + fn + fp)
        + CAST(2 * tp AS DOUBLE) / (2 * tp + fn + fp)) / 2 FROM {_CELLS}
      UNION ALL SELECT 'roc_auc', value FROM ({_AUC}))""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    scored = scored_labels(spark, sf)
    return rounded(classification_metrics(scored, "quality", "prediction", "score"), "value")


@query("roc_auc", f"SELECT {R('value')} AS value FROM ({_AUC})")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(roc_auc(scored_labels(spark, sf), "quality", "score"), "value")


# -- logistic regression -----------------------------------------------------------------------------------------

QUALITY = ModelSpec("doc_id", "quality", ("n_chars", "in_source"), ("toxic",), ("lang",))


def _logistic(spark: SparkSession, sf: str):
    rows = _labelled_only(spark, sf)
    encoder = fit_encoder(rows, QUALITY.numeric, QUALITY.binary, QUALITY.categorical, drop_first=True)
    return rows, logistic_fit(rows, QUALITY.target, encoder)


@query(
    "logistic_fit",
    """SELECT unnest(['num__n_chars', 'num__in_source', 'bin__toxic', 'cat__lang_en', 'cat__lang_es', 'cat__lang_fr',
      'intercept']) AS variable, CAST(0 AS DOUBLE) AS gradient FROM (SELECT count(*) FROM labels)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The gradient of the penalised loss, per row, at the fitted coefficients: zero where the fit is optimal."""
    rows, model = _logistic(spark, sf)
    n = rows.count()
    counts = {row["quality"]: row["n"] for row in rows.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    weight = F.lit(n / 2.0) / F.when(F.col("quality") == 1, F.lit(counts[1])).otherwise(F.lit(counts[0]))
    scored = logistic_score(rows, model, rows.columns)
    residual = weight * (F.col("probability") - F.col("quality"))
    features = {**model.encoder.scaled(), **model.encoder.flags(), "intercept": F.lit(1.0)}
    weights = [*map(float, model.coefficients), model.intercept]
    sums = scored.agg(*[F.sum(residual * value).alias(name) for name, value in features.items()])
    entries = [(F.lit(name), (r6((F.col(name) + w) / n) + F.lit(0.0)).alias("g")) for name, w in zip(features, weights)]
    return stack_row(sums, entries, ("variable", "gradient"))


# A model with given coefficients: its scores and its table have a closed form.
GIVEN_WEIGHTS = (0.8, -0.3, 0.5, -0.2, 0.1, 0.4)
GIVEN_INTERCEPT = -0.25
_GIVEN_NAMES = ("num__n_chars", "num__in_source", "bin__toxic", "cat__lang_en", "cat__lang_es", "cat__lang_fr")
_KNOWN = f"""(SELECT k.*, s.in_source, (n_chars - avg(n_chars) OVER ()) / stddev_pop(n_chars) OVER () AS z1,
  (in_source - avg(in_source) OVER ()) / nullif(stddev_pop(in_source) OVER (), 0) AS z2
  FROM {LABELLED} k JOIN (SELECT source, count(*) AS in_source FROM {LABELLED} WHERE quality IS NOT NULL GROUP BY source) s
  ON k.source = s.source WHERE k.quality IS NOT NULL)"""
_MARGIN = """(-0.25 + 0.8 * z1 - 0.3 * coalesce(z2, 0) + 0.5 * toxic
  + CASE lang WHEN 'en' THEN -0.2 WHEN 'es' THEN 0.1 WHEN 'fr' THEN 0.4 ELSE 0 END)"""


def _given_model(rows: DataFrame) -> LogisticModel:
    encoder = fit_encoder(rows, QUALITY.numeric, QUALITY.binary, QUALITY.categorical, drop_first=True)
    return LogisticModel(encoder, GIVEN_INTERCEPT, GIVEN_WEIGHTS)


@query(
    "logistic_score",
    f"""SELECT doc_id, quality, {R(f"1 / (1 + exp(-{_MARGIN}))")} AS probability,
      CASE WHEN {_MARGIN} > 0 THEN 1 ELSE 0 END AS prediction FROM {_KNOWN}""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = _labelled_only(spark, sf)
    return rounded(logistic_score(rows, _given_model(rows), ["doc_id", "quality"]), "probability")


@query(
    "coefficient_table",
    "SELECT variable, coefficient, abs(coefficient) AS abs_coefficient FROM (SELECT * FROM (VALUES "
    + ", ".join(f"('{name}', CAST({weight} AS DOUBLE))" for name, weight in zip(_GIVEN_NAMES, GIVEN_WEIGHTS))
    + ") v(variable, coefficient)) WHERE (SELECT count(*) FROM labels) > 0",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return coefficient_table(spark, _given_model(_labelled_only(spark, sf)))


def _register_flow(prefix: str, flow, names: tuple[str, ...]) -> None:
    for name in names:
        query(prefix if name == names[0] else f"{prefix}_{name}")(
            lambda spark, sf, name=name: flow(spark, sf)[name]
        )


def _supervised(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return supervised_flow(_labelled_only(spark, sf), QUALITY)


_register_flow("supervised_flow", _supervised, ("metrics", "confusion", "coefficients"))


@query(
    "supervised_flow_split",
    """WITH t AS (SELECT count(*) AS n, count(*) FILTER (WHERE quality = 1) AS pos FROM labels),
      q AS (SELECT n, pos, n - ceil(n * CAST(0.3 AS DOUBLE)) AS n_train, pos / CAST(n AS DOUBLE) * (n - ceil(n * CAST(0.3 AS DOUBLE))) AS share FROM t),
      k AS (SELECT n, pos, n_train, CASE WHEN share - floor(share) > 0.5 THEN floor(share) + 1 ELSE floor(share) END AS pos_train FROM q)
      SELECT 'train' AS split, CAST(n_train AS BIGINT) AS n_rows, CAST(pos_train AS BIGINT) AS n_positive,
        CAST(n_train - pos_train AS BIGINT) AS n_negative FROM k
      UNION ALL SELECT 'test', CAST(n - n_train AS BIGINT), CAST(pos - pos_train AS BIGINT),
        CAST(n - n_train - pos + pos_train AS BIGINT) FROM k""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _supervised(spark, sf)["split"]


# -- clusters ----------------------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    embeddings = table(spark, sf, "embeddings")
    return embeddings.select("vec_id", "label", array_to_vector("embedding").alias("features"))


# Fits from fixed starts, which a recursive query can follow round by round: start s takes the rows 6 s, 6 s + 1, ...
FIXED_STARTS, LARGEST_K, SQL_ROUNDS = 4, 6, 60


def _first_centres(vectors: DataFrame, starts: int) -> list[np.ndarray]:
    rows = vectors.where(F.col("vec_id") < starts * LARGEST_K).orderBy("vec_id").select("features").collect()
    centres = np.array([row[0].toArray() for row in rows])
    return [centres[s * LARGEST_K : (s + 1) * LARGEST_K] for s in range(starts)]


def _lloyd_sql(starts: int, ks: str) -> str:
    """Rounds of assignment and means; fit: the last centres of each start s and k, with their cost; best: the best start."""
    return f"""WITH RECURSIVE pts AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    rounds AS (
      SELECT 0 AS i, s.s, k.k, c.c, p.x AS centre FROM (SELECT unnest(range({starts})) AS s) s, (SELECT unnest({ks}) AS k) k,
        (SELECT unnest(range({LARGEST_K})) AS c) c, pts p WHERE c.c < k.k AND p.vec_id = {LARGEST_K} * s.s + c.c
      UNION ALL
      SELECT i + 1, s, k, c, list(m ORDER BY axis) FROM (
        SELECT n.i, n.s, n.k, n.c, g.axis, avg(p.x[g.axis]) AS m FROM (
          SELECT r.i, r.s, r.k, p.vec_id, arg_min(r.c, list_distance(p.x, r.centre)) AS c FROM rounds r, pts p
          WHERE r.i < {SQL_ROUNDS} GROUP BY ALL) n
        JOIN pts p ON p.vec_id = n.vec_id, (SELECT unnest(range(1, 65)) AS axis) g GROUP BY ALL) GROUP BY i, s, k, c),
    near AS (SELECT r.s, r.k, p.vec_id, arg_min(r.c, list_distance(p.x, r.centre)) AS c, min(list_distance(p.x, r.centre)) AS d
      FROM rounds r, pts p WHERE r.i = {SQL_ROUNDS} GROUP BY ALL),
    costs AS (SELECT s, k, sum(d * d) AS inertia FROM near GROUP BY s, k),
    best AS (SELECT k, arg_min(s, inertia) AS s, min(inertia) AS inertia FROM costs GROUP BY k),
    fit AS (SELECT r.k, r.c, r.centre, b.inertia, row_number() OVER (PARTITION BY r.k ORDER BY r.centre[1]) - 1 AS side
      FROM rounds r JOIN best b ON r.s = b.s AND r.k = b.k WHERE r.i = {SQL_ROUNDS}),
    labelled AS (SELECT n.k, n.vec_id, n.c FROM near n JOIN best b ON n.s = b.s AND n.k = b.k)"""


def _fixed_fit(spark: SparkSession, sf: str) -> tuple[DataFrame, ClusterModel]:
    vectors = stage(_vectors(spark, sf), "vectors")
    return vectors, kmeans_fit(vectors, 3, tolerance=1e-9, first=_first_centres(vectors, 1))


def _sides(model: ClusterModel) -> list[int]:
    """The place of each centre by its first coordinate, as numbers of clusters depend on the start."""
    return np.argsort(np.argsort(model.centres[:, 0])).tolist()


@query(
    "kmeans_fit",
    f"""{_lloyd_sql(1, "[3]")} SELECT CAST(side AS INTEGER) AS side, CAST(axis AS INTEGER) AS axis,
      {R("centre[axis + 1]")} AS centre, {R("inertia")} AS inertia FROM fit, (SELECT unnest(range(64)) AS axis)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    _, model = _fixed_fit(spark, sf)
    rows = [
        (side, axis, value, model.inertia)
        for side, centre in zip(_sides(model), model.centres.tolist())
        for axis, value in enumerate(centre)
    ]
    return rounded(spark.createDataFrame(rows, "side int, axis int, centre double, inertia double"), "centre", "inertia")


_SWEEP = f"""{_lloyd_sql(FIXED_STARTS, f"range(2, {LARGEST_K + 1})")},
    pairs AS (SELECT a.k, a.vec_id, a.c AS own, b.c AS other, avg(list_distance(p.x, q.x)) AS m FROM labelled a
      JOIN labelled b ON a.k = b.k AND a.vec_id <> b.vec_id JOIN pts p ON p.vec_id = a.vec_id JOIN pts q ON q.vec_id = b.vec_id
      GROUP BY a.k, a.vec_id, a.c, b.c),
    sides AS (SELECT k, vec_id, max(CASE WHEN own = other THEN m END) AS a, min(CASE WHEN own <> other THEN m END) AS b
      FROM pairs GROUP BY k, vec_id),
    scores AS (SELECT k, avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM sides GROUP BY k)
    SELECT CAST(b.k AS INTEGER) AS k, {R("inertia")} AS inertia, {R("silhouette")} AS silhouette,
      CAST(0 AS DOUBLE) AS silhouette_error FROM best b JOIN scores s ON b.k = s.k"""


def _sweep(spark: SparkSession, sf: str) -> DataFrame:
    vectors = stage(_vectors(spark, sf), "vectors")
    sweep = kmeans_sweep(vectors, 2, LARGEST_K, tolerance=1e-9, first=_first_centres(vectors, FIXED_STARTS))
    return rounded(sweep.scores, "inertia", "silhouette", "silhouette_error")


@query("kmeans_sweep", _SWEEP)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _sweep(spark, sf)


@query("best_k", f"SELECT * FROM ({_SWEEP}) ORDER BY silhouette DESC, k LIMIT 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return best_k(_sweep(spark, sf))


@query(
    "cluster_assignments",
    f"""{_lloyd_sql(1, "[3]")} SELECT p.vec_id, p.label, CAST(f.side AS INTEGER) AS side
      FROM labelled l JOIN fit f ON l.c = f.c JOIN pts p ON p.vec_id = l.vec_id""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    vectors, model = _fixed_fit(spark, sf)
    side = F.element_at(F.array(*[F.lit(s) for s in _sides(model)]), F.col("cluster") + 1)
    return cluster_assignments(vectors, model, "vec_id", ["label"]).select("vec_id", "label", side.alias("side"))


_POINTS = """points AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS axis,
  CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"""


@query(
    "inertia",
    f"""WITH {_POINTS}, centres AS (SELECT label, axis, avg(x) AS c FROM points GROUP BY label, axis)
      SELECT {R("sum(pow(p.x - c.c, 2))")} AS inertia FROM points p JOIN centres c ON p.label = c.label AND p.axis = c.axis""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inertia(_vectors(spark, sf), "features", "label"), "inertia")


def _silhouette_sql(distance: str) -> str:
    return f"""WITH pairs AS (SELECT a.vec_id, a.label AS own, b.label AS other, {distance} AS d
        FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
      means AS (SELECT vec_id, own, other, avg(d) AS m FROM pairs GROUP BY vec_id, own, other),
      sides AS (SELECT vec_id, max(CASE WHEN own = other THEN m END) AS a, min(CASE WHEN own <> other THEN m END) AS b
        FROM means GROUP BY vec_id)
      SELECT {R("avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END)")} AS silhouette FROM sides"""


_DISTANCE = "list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query("silhouette", _silhouette_sql(f"pow({_DISTANCE}, 2)"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(silhouette(_vectors(spark, sf), "features", "label"), "silhouette")


@query("silhouette_euclidean", _silhouette_sql(_DISTANCE))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(euclidean_silhouette(_vectors(spark, sf), "features", "label").select("silhouette"), "silhouette")


@query("silhouette_exact", _silhouette_sql(_DISTANCE))
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = euclidean_silhouette(_vectors(spark, sf), "features", "label", exact=True)
    return rounded(found.select("silhouette"), "silhouette")


def _power_sql(matrix: str, name: str) -> str:
    """The leading eigenvector of a symmetric matrix (a, b, v): its 2^17th power by squaring, and its longest column."""
    return f"""{name}_powers AS (
      SELECT 0 AS turn, a, b, v FROM {matrix}
      UNION ALL
      SELECT turn + 1, a, b, v / max(abs(v)) OVER () FROM (SELECT l.turn, l.a, r.b, sum(l.v * r.v) AS v
        FROM {name}_powers l JOIN {name}_powers r ON l.b = r.a WHERE l.turn < 17 GROUP BY l.turn, l.a, r.b)),
    {name}_column AS (SELECT b, sqrt(sum(v * v)) AS size FROM {name}_powers WHERE turn = 17 GROUP BY b ORDER BY 2 DESC LIMIT 1),
    {name}_unit AS (SELECT p.a, p.v / c.size AS u FROM {name}_powers p JOIN {name}_column c ON p.b = c.b WHERE turn = 17),
    {name} AS (SELECT a, u * (SELECT sign(arg_max(u, abs(u))) FROM {name}_unit) AS u FROM {name}_unit),
    {name}_value AS (SELECT sum(l.u * m.v * r.u) AS value FROM {matrix} m JOIN {name} l ON m.a = l.a JOIN {name} r ON m.b = r.a)"""


_PCA = f"""WITH RECURSIVE {_POINTS},
  means AS (SELECT axis, avg(x) AS m FROM points GROUP BY axis),
  cells AS MATERIALIZED (SELECT vec_id, label, p.axis, x - m AS x FROM points p JOIN means ON p.axis = means.axis),
  spread AS MATERIALIZED (SELECT l.axis AS a, r.axis AS b, sum(l.x * r.x) / ((SELECT count(*) FROM embeddings) - 1) AS v
    FROM cells l JOIN cells r ON l.vec_id = r.vec_id GROUP BY l.axis, r.axis),
  {_power_sql("spread", "first")},
  rest AS MATERIALIZED (SELECT s.a, s.b, s.v - f.value * l.u * r.u AS v FROM spread s JOIN first l ON s.a = l.a JOIN first r ON s.b = r.a,
    first_value f),
  {_power_sql("rest", "second")},
  total AS (SELECT sum(v) AS v FROM spread WHERE a = b),
  t AS (SELECT vec_id, label, sum(x * f.u) AS pca_1, sum(x * s.u) AS pca_2, max(fv.value / total.v) AS share_pca_1,
      max(sv.value / total.v) AS share_pca_2 FROM cells JOIN first f ON axis = f.a JOIN second s ON axis = s.a, first_value fv,
    second_value sv, total GROUP BY vec_id, label)"""
_PCA_COLUMNS = ("pca_1", "pca_2", "share_pca_1", "share_pca_2")


def _projection(spark: SparkSession, sf: str) -> DataFrame:
    return pca_2d(_vectors(spark, sf), keep=("vec_id", "label"))


@query("pca_2d", f"""{_PCA} SELECT vec_id, label, {", ".join(f"{R(name)} AS {name}" for name in _PCA_COLUMNS)} FROM t""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_projection(spark, sf), *_PCA_COLUMNS)


@query(
    "pca_scaled",
    f"""{_PCA} SELECT vec_id, label, {", ".join(f"{R(name)} AS {name}" for name in _PCA_COLUMNS)},
      {R("(pca_1 - min(pca_1) OVER ()) / (max(pca_1) OVER () - min(pca_1) OVER ())")} AS pca_1_scaled,
      {R("(pca_2 - min(pca_2) OVER ()) / (max(pca_2) OVER () - min(pca_2) OVER ())")} AS pca_2_scaled FROM t""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    scaled = pca_scaled(stage(_projection(spark, sf), "projection"))
    return rounded(scaled, *_PCA_COLUMNS, "pca_1_scaled", "pca_2_scaled")


_PROFILE = f"""SELECT lang, count(*) AS n_rows, {PCT("count(*)", "(SELECT count(*) FROM documents)")} AS pct_rows,
    round_even(avg(quality) * 100, 2) AS pct_quality, round_even(avg(toxic) * 100, 2) AS pct_toxic,
    round_even(avg(n_chars), 2) AS mean_n_chars, (SELECT source FROM (SELECT source, count(*) AS n FROM documents i
      WHERE i.lang = o.lang GROUP BY source) ORDER BY n DESC, source LIMIT 1) AS source_mode
  FROM {LABELLED} o GROUP BY lang"""


def _profile(spark: SparkSession, sf: str) -> DataFrame:
    return cluster_profile(labelled(spark, sf), "lang", ["quality", "toxic"], ["n_chars"], ["source"])


@query("cluster_profile", _PROFILE)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _profile(spark, sf)


@query("cluster_bars", f"SELECT lang, n_rows, pct_rows, pct_quality FROM ({_PROFILE})")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return cluster_bars(_profile(spark, sf), "lang", "quality")



def _cluster_spec() -> ModelSpec:
    return ModelSpec("doc_id", "quality", ("n_chars",), ("toxic",), ("lang",))


def _clustering(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return clustering_flow(_labelled_only(spark, sf), _cluster_spec())


_register_flow("clustering_flow", _clustering, ("k_scores", "profile", "pca"))

# -- association flow --------------------------------------------------------------------------------------------


def _association(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return association_flow(labelled(spark, sf), "lang", "quality", ["en", "fr"], "other", "lang_group")


@query(
    "association_flow",
    f"""{chi_square_sql("lang", "lang", LABELLED)} UNION ALL {_COLLAPSED_SQL}""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    tables = _association(spark, sf)
    return rounded(union_reports(tables["result_original"], tables["result_collapsed"]), *_CHI)


@query("association_flow_percent", _percent_sql("lang_group", COLLAPSED))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _association(spark, sf)["percent_collapsed"]


@query("association_flow_expected", _expected_sql("lang_group", COLLAPSED))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_association(spark, sf)["expected_collapsed"], "expected_negative", "expected_positive")


@query(
    "association_flow_comments",
    " UNION ALL ".join(
        f"""SELECT 'normality' AS aspect, 'not applicable to frequencies' AS "comment"
          UNION ALL SELECT 'result', row_variable || ': ' || decision FROM ({test})
          UNION ALL SELECT 'effect_size', 'V = ' || printf('%.3f', cramers_v) || ', ' || strength FROM ({test})"""
        for test in (chi_square_sql("lang", "lang", LABELLED), _COLLAPSED_SQL)
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _association(spark, sf)["comments"]
