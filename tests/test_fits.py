"""Iterative fits over scans: batched k-means, silhouettes, principal components, logistic regression."""

import numpy as np
import pytest
from pyspark.ml.linalg import SparseVector, Vectors
from pyspark.sql import functions as F

from tabscope.operators import lloyd, newton, projection, sums
from tabscope.operators.clusters import kmeans_fit, kmeans_sweep, pca_2d
from tabscope.operators.newton import Problem, trust_region
from tabscope.operators.projection import fit_components
from tabscope.operators.silhouettes import euclidean_silhouette

from test_models import _silhouette


@pytest.fixture
def always_sparse(monkeypatch):
    """Work on rows as if they were too wide for a dense matrix."""
    for module in (sums, lloyd, projection):
        monkeypatch.setattr(module, "DENSE_WIDTH", 0)
    monkeypatch.setattr(newton, "WHOLE_HESSIAN", 0)


def blobs(n, spread, seed=4, width=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 6, (5, width))
    labels = rng.integers(0, 5, n)
    return centres[labels] + rng.normal(0, spread, (n, width)), labels


def frame(spark, x, **others):
    rows = [(Vectors.dense(v), *[other[i].item() for other in others.values()]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, ["features", *others]).repartition(5)


def plain_lloyd(x, centres):
    for _ in range(200):
        labels = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([x[labels == c].mean(0) if (labels == c).any() else centres[c] for c in range(len(centres))])
    return centres, ((x - centres[labels]) ** 2).sum()


@pytest.mark.parametrize("wide", [False, True])
def test_all_starts_equal_plain_rounds(spark, wide, request):
    if wide:
        request.getfixturevalue("always_sparse")
    x, _ = blobs(300, 2.0)
    data = sums.vectors(frame(spark, x))
    shift = lloyd.middle(data)
    first = lloyd.seeds(data, 6, range(4), 7, shift)
    runs = [lloyd.Start(number, first[number][:k]) for k in (2, 3, 6) for number in first]
    for run, done in zip(runs, lloyd.lloyd(data, runs, shift, tolerance=1e-9)):
        centres, cost = plain_lloyd(x - shift, run.centres)
        found, wanted = (own[np.argsort(own[:, 0])] for own in (done.centres, centres))
        assert np.allclose(found, wanted) and done.cost == pytest.approx(cost)


def test_seeds_are_rows_far_apart(spark):
    x, labels = blobs(400, 0.01)
    first = lloyd.seeds(sums.vectors(frame(spark, x)), 5, range(8), 3, np.zeros(3))
    for centres in first.values():
        own = ((x[:, None] - centres[None]) ** 2).sum(2)
        assert np.allclose(own.min(0), 0.0)
        assert len(set(labels[own.argmin(0)])) == 5


def test_one_scan_a_round_serves_the_sweep(spark, monkeypatch):
    x, _ = blobs(200, 2.5)
    active, scans, plain = [], [], sums.Vectors.summed
    monkeypatch.setattr(sums.Vectors, "summed", lambda self, task, size: scans.append(size) or plain(self, task, size))
    one_round = lloyd._round
    monkeypatch.setattr(lloyd, "_round", lambda data, runs, shift: active.append(len(runs)) or one_round(data, runs, shift))
    sweep = kmeans_sweep(frame(spark, x), 2, 5, n_init=6)
    # Runs leave the scans as they come to rest; the last scan takes the cost of those that are not twins of others.
    assert active[0] == 24 and active[:-1] == sorted(active[:-1], reverse=True) and active[-1] <= 24
    assert max(model.rounds for model in sweep.models.values()) <= len(active) - 1
    # Beside the rounds: the middle, the sizes of the clusters and the silhouettes.
    assert len(scans) == len(active) + 3


def test_fewer_points_than_centres(spark):
    df = frame(spark, np.array([[1.0, 2.0]] * 5 + [[3.0, 4.0]] * 5))
    model = kmeans_fit(df, 3, n_init=2)
    assert model.inertia == pytest.approx(0.0)
    assert model.transform(df).groupBy("cluster").count().count() == 2


def test_offset_data_keep_their_digits(spark):
    x, _ = blobs(200, 0.5)
    model = kmeans_fit(frame(spark, x + 1e7), 5, n_init=5)
    assert model.inertia == pytest.approx(kmeans_fit(frame(spark, x), 5, n_init=5).inertia, rel=1e-4)


@pytest.mark.parametrize("wide", [False, True])
def test_silhouette_by_definition(spark, wide, request):
    if wide:
        request.getfixturevalue("always_sparse")
    x, labels = blobs(150, 2.5)
    labels[labels == 4] = 3
    labels[0] = 4  # alone in its cluster
    df = frame(spark, x, cluster=labels)
    want = _silhouette(x, labels, 1)
    found = euclidean_silhouette(df).first()
    assert (found["silhouette"], found["error"], found["n_rows"]) == (pytest.approx(want), 0.0, 150)
    assert euclidean_silhouette(df, exact=True).first()["silhouette"] == pytest.approx(want)


def test_sampled_silhouette_is_within_its_error(spark, monkeypatch):
    from tabscope.operators import silhouettes

    x, labels = blobs(900, 3.0)
    df = frame(spark, x, cluster=labels)
    want = _silhouette(x, labels, 1)
    for seed in range(3):
        found = euclidean_silhouette(df, anchors=48, seed=seed).first()
        assert 0 < abs(found["silhouette"] - want) <= found["error"] < 0.1
    monkeypatch.setattr(silhouettes, "BLOCK_ROWS", 100)
    assert euclidean_silhouette(df, exact=True).first()["silhouette"] == pytest.approx(want)
    assert tuple(euclidean_silhouette(df.limit(0)).first()) == (0.0, 0.0, 0)
    assert euclidean_silhouette(df.where("cluster = 1")).first()["silhouette"] == 0.0


@pytest.mark.parametrize("wide", [False, True])
def test_components_of_sparse_rows(spark, wide, request):
    if wide:
        request.getfixturevalue("always_sparse")
    rng = np.random.default_rng(9)
    width = 40
    level = rng.choice(width - 1, 500, p=np.arange(1, width) / np.arange(1, width).sum())
    number = rng.normal(3, 1, 500)
    x = np.zeros((500, width))
    x[np.arange(500), level] = 1.0
    x[:, -1] = number
    rows = [(i, SparseVector(width, {int(level[i]): 1.0, width - 1: float(number[i])})) for i in range(500)]
    df = spark.createDataFrame(rows, ["id", "features"]).repartition(4)
    centred = x - x.mean(0)
    values, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), [0, 1]])
    model = fit_components(df)
    assert np.allclose(model.loadings, axes, atol=1e-6)
    assert model.shares == pytest.approx(tuple(values[::-1][:2] / values.sum()))
    got = pca_2d(df, keep=("id",)).orderBy("id").collect()
    assert np.allclose([[r["pca_1"], r["pca_2"]] for r in got], centred @ axes, atol=1e-6)


def test_components_of_flat_and_missing_rows(spark):
    rows = [(1, Vectors.dense(1.0, 2.0)), (2, Vectors.dense(1.0, 4.0)), (3, None)]
    df = spark.createDataFrame(rows, ["id", "features"])
    rows = {r["id"]: r for r in pca_2d(df, keep=("id",)).collect()}
    assert (rows[1]["pca_1"], rows[2]["pca_1"], rows[3]["pca_1"]) == (pytest.approx(-1.0), pytest.approx(1.0), None)
    assert (rows[1]["pca_2"], rows[1]["share_pca_1"], rows[1]["share_pca_2"]) == (0.0, pytest.approx(1.0), 0.0)
    same = pca_2d(df.where("id = 1"), keep=("id",)).first()
    assert (same["pca_1"], same["share_pca_1"]) == (0.0, 0.0)


def optimum(x, y, weights, c, penalty):
    """Newton steps with halving, to a gradient of nothing."""
    full, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    side = 2 * y - 1

    def value(w):
        return 0.5 * penalty @ (w * w) + c * weights @ np.logaddexp(0, -side * (full @ w))

    for _ in range(200):
        p = 1 / (1 + np.exp(-(full @ w)))
        gradient = penalty * w + c * full.T @ (weights * (p - y))
        step = np.linalg.lstsq(np.diag(penalty) + c * (full.T * (weights * p * (1 - p))) @ full, gradient, rcond=None)[0]
        size = 1.0
        while value(w - size * step) > value(w) and size > 1e-9:
            size /= 2
        w = w - size * step
    return w


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("kind", ["plain", "collinear", "separable", "free bias"])
def test_newton(spark, kind, wide, request):
    if wide:
        request.getfixturevalue("always_sparse")
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (200, 4)) * [1, 5, 0.1, 1]
    if kind == "collinear":
        x[:, 3] = 2 * x[:, 0] - x[:, 1]
    y = (x[:, 0] + (0 if kind == "separable" else 1) * rng.normal(0, 1, 200) > 0.5).astype(float)
    weights, c = rng.uniform(0.5, 2, 200), 100.0 if kind == "separable" else 1.0
    data = sums.vectors(frame(spark, x, label=y, weight=weights), others=["label", "weight"])
    penalty = np.ones(5)
    penalty[-1] = 0.0 if kind == "free bias" else 1.0
    fit = trust_region(Problem(data, c, penalty), tolerance=1e-8)
    assert fit.gradient <= 1e-8 * fit.gradient_at_zero
    assert np.allclose(fit.weights, optimum(x, y, weights, c, penalty), rtol=1e-5, atol=1e-6)


def test_sums_by_one_stage_or_two(spark, monkeypatch):
    x, _ = blobs(100, 1.0, width=9000)
    data = sums.vectors(frame(spark, x).select("features"))

    def task(batches):
        total = np.zeros(9000)
        for rows in batches:
            total += rows.weighted(np.ones((len(rows), 1)))[0]
        return total

    assert np.allclose(data.summed(task, 9000), x.sum(0))
    monkeypatch.setattr(sums, "DIRECT", 0)
    assert np.allclose(data.summed(task, 9000), x.sum(0))


def test_empty_and_mixed_rows(spark):
    rows = [(Vectors.dense(1.0, 0.0, 2.0),), (Vectors.sparse(3, {1: 5.0}),), (Vectors.sparse(3, {}),), (None,)]
    schema = frame(spark, np.zeros((1, 3))).schema
    data = sums.vectors(spark.createDataFrame(rows, schema))

    def task(batches):
        total = np.zeros(5)
        for part in batches:
            total[:3] += part.weighted(np.ones((len(part), 1)))[0]
            total[3] += part.squares().sum()
            total[4] += len(part)
        return total

    assert data.summed(task, 5).tolist() == [1.0, 5.0, 2.0, 30.0, 3.0]
    assert data.table.agg(F.max("row")).first()[0] is not None


def test_many_levels_stay_in_tables(spark, monkeypatch):
    """Thousands of levels: fitted by sparse rows, scored and listed by joins, never listed on the driver."""
    from tabscope.operators import features, joins
    from tabscope.operators.features import feature_names, fit_encoder
    from tabscope.operators.models import coefficient_table, logistic_fit, logistic_score

    monkeypatch.setattr(features, "MOST_COLUMNS", 10)
    monkeypatch.setattr(joins.lookup_join, "__defaults__", (None, False, 0))
    n = 6000
    df = spark.range(n).select(
        "id",
        F.when(F.col("id") % 7 == 0, "hot").otherwise(F.format_string("l%05d", F.col("id") % 2500)).alias("c"),
        F.when(F.col("id") % 11 > 0, F.format_string("k%d", F.col("id") % 3)).alias("d"),
        (F.col("id") * 7919 % 1000 / 100.0).alias("x"),
        ((F.col("id") * 31 % 97) > 40).cast("int").alias("y"),
    )
    encoder = fit_encoder(df, ["x"], [], ["c", "d"], drop_first=True)
    levels = sorted({"hot"} | {f"l{i % 2500:05d}" for i in range(n) if i % 7})
    assert encoder.width == 1 + len(levels) - 1 + 2
    names = {r["position"]: r["feature"] for r in feature_names(spark, encoder).collect()}
    assert [names[i] for i in range(encoder.width)] == ["num__x", *[f"cat__c_{x}" for x in levels[1:]], "cat__d_k1", "cat__d_k2"]
    with pytest.raises(ValueError, match="too many columns"):
        encoder.names
    model = logistic_fit(df, "y", encoder, tolerance=1e-8)
    rows = df.collect()
    x = np.zeros((n, encoder.width))
    at = {name: i for i, name in names.items()}
    numbers = np.array([r["x"] for r in rows])
    x[:, 0] = (numbers - numbers.mean()) / numbers.std()
    for i, r in enumerate(rows):
        for name in (f"cat__c_{r['c']}", f"cat__d_{r['d']}"):
            if name in at:
                x[i, at[name]] = 1.0
    y = np.array([r["y"] for r in rows])
    weights = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    p = 1 / (1 + np.exp(-(x @ model.coefficients + model.intercept)))
    gradient = np.r_[x.T @ (weights * (p - y)), (weights * (p - y)).sum()] + np.r_[model.coefficients, model.intercept]
    start = np.r_[x.T @ (weights * (0.5 - y)), (weights * (0.5 - y)).sum()]
    assert np.linalg.norm(gradient) <= 1e-6 * np.linalg.norm(start)
    scored = {r["id"]: r["probability"] for r in logistic_score(df, model, ["id"]).collect()}
    assert np.allclose([scored[r["id"]] for r in rows], p)
    table = coefficient_table(spark, model).collect()
    assert {r["variable"]: r["coefficient"] for r in table} == pytest.approx({name: model.coefficients[i] for name, i in at.items()})
