"""Encoding, logistic regression, clusters."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tabscope.operators.clusters import (
    best_k,
    cluster_assignments,
    cluster_profile,
    inertia,
    kmeans_fit,
    kmeans_sweep,
    pca_2d,
    pca_scaled,
    silhouette,
)
from tabscope.operators.features import feature_names, fit_encoder, level_index, one_hot, standardize
from tabscope.operators.models import coefficient_table, logistic_fit, logistic_score, top_coefficients


def test_encoder(spark):
    train = spark.createDataFrame([(1.0, 0, "b"), (3.0, 1, "a"), (5.0, 1, None)], "x double, f int, c string")
    encoder = fit_encoder(train, ["x"], ["f"], ["c"], levels={"c": ["a", "b", "z"]})
    assert encoder.names == ["num__x", "bin__f", "cat__c_a", "cat__c_b", "cat__c_z"]
    new = spark.createDataFrame([(3.0, 1, "unknown"), (5.0, 0, "z"), (1.0, 0, None)], "x double, f int, c string")
    rows = [list(row[0]) for row in encoder.assemble(new).select(vector_to_array("features")).collect()]
    deviation = np.std([1.0, 3.0, 5.0])
    assert rows == [[0, 1, 0, 0, 0], [pytest.approx(2 / deviation), 0, 0, 0, 1], [pytest.approx(-2 / deviation), 0, 0, 0, 0]]
    dropped = fit_encoder(train, categorical=["c"], drop_first=True)
    assert dropped.names == ["cat__c_b"]
    assert [row["feature"] for row in feature_names(spark, encoder).orderBy("position").collect()] == encoder.names
    assert one_hot(train, ["c"], ["x"]).columns == ["x", "c_a", "c_b"]
    flat = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [row["x_z"] for row in standardize(flat, ["x"]).collect()] == [0.0, 0.0]
    many = spark.range(4500).select(F.format_string("l%04d", F.col("id") % 1500).alias("c"))
    assert level_index(many, ["c"]).sizes == {"c": 1500}
    wide = fit_encoder(many, categorical=["c"], drop_first=True)
    vector = wide.assemble(many.where("c = 'l0700'").limit(1)).first()["features"]
    assert vector.size == 1499 and vector.indices.tolist() == [699] and vector.values.tolist() == [1.0]


def _newton(x, y, weights):
    """Balanced L2 logistic regression with a penalised bias, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (weights * (p - y)) + w
        hessian = (x.T * (weights * p * (1 - p))) @ x + np.eye(len(w))
        w -= np.linalg.solve(hessian, gradient)
    return w


@pytest.fixture(scope="module")
def labelled_rows():
    rng = np.random.default_rng(11)
    x = rng.normal(0, 1, (300, 2))
    f = rng.integers(0, 2, 300)
    c = rng.choice(["a", "b", "c"], 300)
    y = (x[:, 0] + 0.8 * f - 0.5 * (c == "b") + rng.normal(0, 1, 300) > -0.8).astype(int)
    return x, f, c, y


def test_logistic_equals_newton(spark, labelled_rows):
    x, f, c, y = labelled_rows
    rows = [(i, *map(float, x[i]), int(f[i]), str(c[i]), int(y[i])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x1 double, x2 double, f int, c string, y int")
    encoder = fit_encoder(df, ["x1", "x2"], ["f"], ["c"], drop_first=True)
    model = logistic_fit(df, "y", encoder)
    z = (x - x.mean(0)) / x.std(0)
    matrix = np.column_stack([z, f, c == "b", c == "c"]).astype(float)
    weights = np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (1 - y).sum()))
    w = _newton(matrix, y, weights)
    assert list(model.coefficients) == pytest.approx(w[:-1], abs=1e-5)
    assert model.intercept == pytest.approx(w[-1], abs=1e-5)
    p = 1 / (1 + np.exp(-(matrix @ w[:-1] + w[-1])))
    scored = logistic_score(df, model, ["id"]).orderBy("id").collect()
    assert [row["probability"] for row in scored] == pytest.approx(p, abs=1e-5)
    assert [row["prediction"] for row in scored] == (p > 0.5).astype(int).tolist()
    table = coefficient_table(spark, model).collect()
    assert [row["abs_coefficient"] for row in table] == sorted((abs(v) for v in model.coefficients), reverse=True)
    top = [row["coefficient"] for row in top_coefficients(coefficient_table(spark, model), 3).collect()]
    assert top == sorted(row["coefficient"] for row in table[:3])
    free = logistic_fit(df, "y", encoder, penalize_intercept=False)
    assert free.intercept != pytest.approx(model.intercept, abs=1e-4)
    with pytest.raises(ValueError, match="both classes"):
        logistic_fit(df.where("y = 1"), "y", encoder)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(2)
    centres = np.array([[0, 0, 0], [6, 0, 1], [0, 7, -1]])
    labels = rng.integers(0, 3, 240)
    return centres[labels] + rng.normal(0, 1, (240, 3)), labels


@pytest.fixture(scope="module")
def vectors(spark, points):
    x, labels = points
    rows = [(i, [float(v) for v in x[i]], int(labels[i])) for i in range(len(x))]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    return df.withColumn("features", array_to_vector("v"))


def _silhouette(x, labels, power):
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) ** power
    values = []
    for i, own in enumerate(labels):
        means = {g: gaps[i, (labels == g) & (np.arange(len(x)) != i)] for g in set(labels)}
        if not len(means[own]):
            values.append(0.0)
            continue
        a, b = means[own].mean(), min(m.mean() for g, m in means.items() if g != own)
        values.append((b - a) / max(a, b))
    return np.mean(values)


def test_cluster_quality(spark, points, vectors):
    x, labels = points
    within = sum(((x[labels == g] - x[labels == g].mean(0)) ** 2).sum() for g in range(3))
    assert inertia(vectors, "features", "label").first()[0] == pytest.approx(within)
    assert silhouette(vectors, label="label").first()[0] == pytest.approx(_silhouette(x, labels, 2))
    lonely = vectors.withColumn("label", F.when(F.col("id") == 0, 9).otherwise(F.col("label")))
    assert inertia(lonely.where("id = 0"), "features", "label").first()[0] == 0.0


def test_kmeans(spark, points, vectors):
    x, _ = points
    sweep = kmeans_sweep(vectors, 2, 4, n_init=2)
    scores = {row["k"]: row for row in sweep.scores.collect()}
    assert best_k(sweep.scores).first()["k"] == 3
    assert scores[2]["inertia"] > scores[3]["inertia"] > scores[4]["inertia"]
    model = sweep.models[3]
    centres = model.centres
    for row in cluster_assignments(vectors, model, "id", ["label"]).collect():
        assert row["cluster"] == ((centres - x[row["id"]]) ** 2).sum(1).argmin()
    again = kmeans_fit(vectors, 3, n_init=2)
    assert np.allclose(again.centres, centres)
    tied = spark.createDataFrame([(4, 0.5), (2, 0.5), (3, 0.1)], "k int, silhouette double")
    assert best_k(tied).first()["k"] == 2


def test_pca(points, vectors):
    x, _ = points
    centred = x - x.mean(0)
    values, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), [0, 1]])
    rows = pca_2d(vectors, keep=("id",)).orderBy("id").collect()
    assert np.allclose([[row["pca_1"], row["pca_2"]] for row in rows], centred @ axes)
    assert rows[0]["share_pca_1"] == pytest.approx(values[-1] / values.sum())
    scaled = pca_scaled(pca_2d(vectors, keep=("id",))).agg(F.min("pca_1_scaled"), F.max("pca_2_scaled")).first()
    assert tuple(scaled) == (0.0, 1.0)


def test_cluster_profile(spark):
    rows = [(0, 1, 2.0, "b"), (0, 0, 4.0, "a"), (0, 1, 3.0, None), (1, 0, 1.005, "c"), (None, 1, 9.0, "c")]
    df = spark.createDataFrame(rows, "g int, f int, m double, c string")
    got = [tuple(row) for row in cluster_profile(df, "g", ["f"], ["m"], ["c"]).collect()]
    assert got == [(0, 3, 75.0, 66.67, 3.0, "a"), (1, 1, 25.0, 0.0, float(np.round(1.005, 2)), "c")]
