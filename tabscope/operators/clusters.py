"""K-means with restarts, choice of k, cluster quality, cluster profiles and a two-dimensional projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.functions.numbers import min_max_scale, percent, round_half_even
from tabscope.operators import lloyd, sums
from tabscope.operators.columns import require_columns
from tabscope.operators.projection import fit_components, project
from tabscope.operators.silhouettes import ANCHORS, euclidean_silhouettes, nearest

SWEEP_SCHEMA = "k int, inertia double, silhouette double, silhouette_error double"


@dataclass(frozen=True)
class ClusterModel:
    """Centres (k x width) with their cost over the fitted rows; labels rows as MLlib does, dense or sparse."""

    model: KMeansModel
    inertia: float
    rounds: int

    @property
    def centres(self) -> np.ndarray:
        """One centre per label, in the order of the labels."""
        return np.array(self.model.clusterCenters())

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)


def given_centres(spark: SparkSession, centres: np.ndarray, column: str = "features", prediction: str = "cluster") -> KMeansModel:
    """An MLlib model of these centres: a fit of no rounds whose first centres are all rows there are."""
    rows = spark.createDataFrame([(Vectors.dense(centre),) for centre in centres.tolist()], [column])
    fit = KMeans(featuresCol=column, predictionCol=prediction, k=max(len(centres), 2), initMode="random", maxIter=0, seed=1)
    return fit.fit(rows)


def _fits(
    data: sums.Vectors,
    ks: Sequence[int],
    n_init: int,
    seed: int,
    max_iter: int,
    tolerance: float,
    first: Sequence[np.ndarray] | None,
    column: str,
    prediction: str,
) -> tuple[dict[int, ClusterModel], np.ndarray]:
    """The best start of each k, all fitted together; and the middle of the rows."""
    shift = lloyd.middle(data)
    if first is None:
        starts = lloyd.seeds(data, max(ks), range(n_init), seed, shift)
    else:
        starts = {number: np.asarray(centres, np.float64) - shift for number, centres in enumerate(first)}
    wanted = [(k, lloyd.Start(number, centres[:k])) for k in ks for number, centres in starts.items()]
    done = lloyd.lloyd(data, [run for _, run in wanted], shift, max_iter, tolerance)
    models = {}
    for k in ks:
        own = [run for (asked, _), run in zip(wanted, done) if asked == k]
        best = min(own, key=lambda run: (run.cost, run.number))
        centres = given_centres(data.table.sparkSession, best.centres + shift, column, prediction)
        models[k] = ClusterModel(centres, best.cost, best.rounds)
    return models, shift


def kmeans_fit(
    features: DataFrame,
    k: int,
    n_init: int = 20,
    seed: int = 42,
    max_iter: int = 300,
    tolerance: float = 1e-4,
    first: Sequence[np.ndarray] | None = None,
    column: str = "features",
    prediction: str = "cluster",
) -> ClusterModel:
    """The best of ``n_init`` seeded starts, or of the given ``first`` centres, by within-cluster cost.

    All starts are fitted by the same scans, until no centre moves by more than ``tolerance``; see ``lloyd``.
    """
    data = sums.vectors(features, column, name="kmeans")
    return _fits(data, [k], n_init, seed, max_iter, tolerance, first, column, prediction)[0][k]


@dataclass(frozen=True)
class KSweep:
    """Scores per k and the fitted model of each k, so that the chosen one is not fitted again."""

    scores: DataFrame
    models: Mapping[int, ClusterModel]


def kmeans_sweep(
    features: DataFrame,
    k_min: int = 2,
    k_max: int = 6,
    n_init: int = 20,
    seed: int = 42,
    max_iter: int = 300,
    tolerance: float = 1e-4,
    first: Sequence[np.ndarray] | None = None,
    column: str = "features",
    prediction: str = "cluster",
    anchors: int = ANCHORS,
) -> KSweep:
    """Inertia and Euclidean silhouette, with its error, for each k.

    The vectors are written once. All starts of all k share each scan (of ``first`` centres, k of each start serve k): one a centre for the seeds, one a round until all rest,
    and one each for the anchors and the silhouettes of the best models; see ``euclidean_silhouettes``.
    """
    data = sums.vectors(features, column, name="sweep")
    ks = range(k_min, k_max + 1)
    models, shift = _fits(data, ks, n_init, seed, max_iter, tolerance, first, column, prediction)
    scores = euclidean_silhouettes(data, nearest([model.centres - shift for model in models.values()], shift), anchors, seed)
    rows = [(k, model.inertia, score.mean, score.error) for (k, model), score in zip(models.items(), scores)]
    return KSweep(features.sparkSession.createDataFrame(rows, SWEEP_SCHEMA), models)


def best_k(scores: DataFrame, score: str = "silhouette", k: str = "k") -> DataFrame:
    """The row with the highest score, smallest k on ties."""
    return scores.orderBy(F.col(score).desc(), F.col(k).asc()).limit(1)


def inertia(df: DataFrame, column: str, label: str) -> DataFrame:
    """Sum of squared distances to the centre of the own group, from one pass of per-group variances."""
    per_group = df.groupBy(label).agg(
        F.count("*").alias("n"), vector_to_array(Summarizer.variance(F.col(column))).alias("variances")
    )
    spread = F.aggregate("variances", F.lit(0.0), lambda total, value: total + value)
    squares = F.when(F.col("n") > 1, (F.col("n") - 1) * spread).otherwise(F.lit(0.0))
    return per_group.agg(F.sum(squares).alias("inertia"))


def silhouette(df: DataFrame, column: str = "features", label: str = "cluster") -> DataFrame:
    """Mean silhouette of a labelling by squared distances, as one row; linear in the rows."""
    points = df.select(F.col(column).alias("features"), F.col(label).cast("double").alias("label"))
    value = ClusteringEvaluator(featuresCol="features", predictionCol="label", metricName="silhouette").evaluate(points)
    return df.sparkSession.createDataFrame([(float(value),)], "silhouette double")


def cluster_assignments(
    features: DataFrame, model: ClusterModel, key: str, keep: Sequence[str] = ()
) -> DataFrame:
    """Row key, cluster and descriptive columns."""
    labelled = model.transform(features)
    return labelled.select(key, model.model.getPredictionCol(), *keep)


def modes_by_group(df: DataFrame, group: str, columns: Sequence[str], suffix: str = "_mode") -> DataFrame:
    """Most frequent level of each column per group, the smallest on ties, from pre-aggregated level counts."""
    texts = df.select(group, *[F.col(name).cast("string").alias(name) for name in columns])
    counts = (
        texts.unpivot([group], list(columns), "variable", "value")
        .where(F.col("value").isNotNull())
        .groupBy(group, "variable", "value")
        .agg(F.count("*").alias("n"))
    )
    leader = F.struct((-F.col("n")).alias("rank"), F.col("value"))
    return counts.groupBy(group).agg(
        *[
            F.min(F.when(F.col("variable") == name, leader))["value"].alias(f"{name}{suffix}")
            for name in columns
        ]
    )


def cluster_profile(
    df: DataFrame,
    group: str,
    flags: Sequence[str] = (),
    means: Sequence[str] = (),
    categorical: Sequence[str] = (),
) -> DataFrame:
    """Per group: rows, share of all rows, share of each flag, mean of each numeric, most frequent levels."""
    require_columns(df, [group, *flags, *means, *categorical])
    grouped = df.where(F.col(group).isNotNull()).groupBy(group)
    sizes = grouped.agg(
        F.count("*").alias("n_rows"),
        *[round_half_even(F.avg(F.col(name).cast("double")) * 100.0).alias(f"pct_{name}") for name in flags],
        *[round_half_even(F.avg(F.col(name).cast("double"))).alias(f"mean_{name}") for name in means],
    )
    total = sizes.agg(F.sum("n_rows")).scalar()
    others = [name for name in sizes.columns if name not in (group, "n_rows")]
    profile = sizes.select(group, "n_rows", percent(F.col("n_rows"), total).alias("pct_rows"), *others)
    if categorical:
        modes = modes_by_group(df.where(F.col(group).isNotNull()), group, categorical)
        profile = profile.join(modes, group, "left")
    return profile.orderBy(group)


def cluster_bars(profile: DataFrame, group: str, flag: str) -> DataFrame:
    """Weight of each group and its share of ``flag``, for bars."""
    return profile.select(group, "n_rows", "pct_rows", f"pct_{flag}").orderBy(group)


def pca_2d(
    df: DataFrame, column: str = "features", keep: Sequence[str] = ("cluster",), names: tuple[str, str] = ("pca_1", "pca_2")
) -> DataFrame:
    """Centred projection on the first two principal components, with the variance share of each.

    The largest loading of each component is made positive, so that signs do not depend on the solver. Sparse rows stay
    sparse; see ``principal_components``.
    """
    model = fit_components(df, column, len(names))
    points = project(df, model, column, keep, names)
    return points.select("*", *[F.lit(share).alias(f"share_{name}") for share, name in zip(model.shares, names)])


def pca_scaled(projection: DataFrame, names: tuple[str, str] = ("pca_1", "pca_2")) -> DataFrame:
    """The projection with both axes mapped to [0, 1]; both ranges come from one scalar subquery."""
    extent = projection.agg(
        F.struct(
            *[F.min(name).alias(f"low_{name}") for name in names],
            *[F.max(name).alias(f"high_{name}") for name in names],
        ).alias("extent")
    ).scalar()
    return projection.withColumns(
        {
            f"{name}_scaled": min_max_scale(F.col(name), extent[f"low_{name}"], extent[f"high_{name}"])
            for name in names
        }
    )
