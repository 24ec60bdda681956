"""Euclidean silhouettes: mean distances to clusters over anchors drawn from each, or over all rows in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscope.operators.lloyd import distances, moved, uniform
from tabscope.operators.sums import Rows, Vectors, by_value, vectors
from tabscope.session import stage

# Rows of each cluster that distances are measured to; a cluster of no more rows is measured whole.
ANCHORS = 512
# Parts of the anchors, each left out in turn, that the error is measured with.
PARTS = 8
# Rows measured to at a time by the exact form, and rows that a task measures at a time.
BLOCK_ROWS, STEP_ROWS = 4096, 512

Labels = Callable[[Rows], np.ndarray]


@dataclass(frozen=True)
class Score:
    """Mean silhouette, its error (0 if every cluster was measured whole), and rows."""

    mean: float
    error: float
    n_rows: int


def nearest(models: Sequence[np.ndarray], shift: np.ndarray) -> tuple[Labels, list[int]]:
    """Labels (rows x models) by the nearest centre of each model, and the number of clusters of each."""

    def labels(rows: Rows) -> np.ndarray:
        own = moved(rows, shift)
        return np.stack([distances(own, centres).argmin(1) for centres in models], 1)

    return labels, [len(centres) for centres in models]


def _steps(batches: Iterator[Rows]) -> Iterator[Rows]:
    """Batches of at most ``STEP_ROWS`` rows."""
    for rows in batches:
        for at in range(0, len(rows), STEP_ROWS):
            end = min(at + STEP_ROWS, len(rows))
            cells = slice(rows.starts[at], rows.starts[end])
            yield replace(
                rows,
                dense=None if rows.dense is None else rows.dense[at:end],
                starts=rows.starts[at : end + 1] - rows.starts[at],
                indices=rows.indices[cells],
                values=rows.values[cells],
                others={name: value[at:end] for name, value in rows.others.items()},
            )


@dataclass(frozen=True)
class _Anchors:
    """Anchors of one labelling, cluster after cluster and part after part."""

    points: np.ndarray
    rows: np.ndarray
    cluster: np.ndarray
    part: np.ndarray
    sampled: np.ndarray

    def cells(self) -> np.ndarray:
        """Where each (cluster, part) begins; all of them have a place, as anchors are in their order."""
        return np.searchsorted(self.cluster * PARTS + self.part, np.arange(len(self.sampled) * PARTS + 1))


def _anchors(data: Vectors, labels: Labels, sizes: Sequence[int], counts: list[np.ndarray], anchors: int, seed: int) -> list[_Anchors]:
    """The rows of least draw of each cluster of each labelling; the driver holds ``anchors`` rows of each."""

    def task(batches: Iterator[Rows]) -> Iterator[pa.RecordBatch]:
        for rows in _steps(batches):
            keys, own = uniform(rows.others["row"], seed), labels(rows)
            found = [[], [], [], [], []]
            for i, k in enumerate(sizes):
                for c in range(k):
                    members = np.flatnonzero(own[:, i] == c)
                    best = members[np.argsort(keys[members], kind="stable")[:anchors]]
                    one = np.zeros((len(rows), len(best)))
                    one[best, np.arange(len(best))] = 1.0
                    for column, value in zip(found, ([i] * len(best), [c] * len(best), keys[best], rows.others["row"][best], list(rows.weighted(one)))):
                        column.extend(value)
            kinds = pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, kinds)], names=["i", "c", "draw", "row", "point"])

    drawn = data.batches(task, "i int, c int, draw double, row long, point array<double>")
    order = Window.partitionBy("i", "c").orderBy("draw", "row")
    kept = drawn.withColumn("place", F.row_number().over(order)).where(F.col("place") <= anchors).collect()
    out = []
    for i, k in enumerate(sizes):
        own = sorted((r["c"], (r["place"] - 1) % PARTS, r["row"], r["point"]) for r in kept if r["i"] == i)
        points = np.array([r[3] for r in own]).reshape(len(own), data.width)
        cluster, part, rows = (np.array([r[j] for r in own], np.int64) for j in range(3))
        out.append(_Anchors(points, rows, cluster, part, counts[i] > anchors))
    return out


def _silhouettes(sums: np.ndarray, numbers: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Silhouette of rows from sums (rows x clusters) and numbers of distances; 0 for a row alone in its cluster."""
    with np.errstate(divide="ignore", invalid="ignore"):
        means = sums / numbers
    at = np.arange(len(own))
    inside = means[at, own]
    means[at, own] = np.inf
    outside = np.where(np.isnan(means), np.inf, means).min(1, initial=np.inf)
    larger = np.maximum(inside, outside)
    valid = (numbers[at, own] > 0) & np.isfinite(outside) & (larger > 0)
    return np.where(valid, (outside - inside) / np.where(valid, larger, 1.0), 0.0)


def euclidean_silhouettes(data: Vectors, labelled: tuple[Labels, list[int]], anchors: int = ANCHORS, seed: int = 42) -> list[Score]:
    """Mean Euclidean silhouette of each labelling, with three scans for all of them.

    A row's mean distance to a cluster is taken over the cluster's ``anchors`` rows of least draw, without itself. A cluster
    of no more rows is measured whole, so small tables get the silhouette by definition. The error is measured by the
    jackknife: the mean is taken again with each of ``PARTS`` parts of the anchors of sampled clusters left out. It is
    twice the standard error and twice the bias found so; the bias comes from the nearest other cluster, as the least of several
    means is too small while they are uncertain.
    """
    labels, sizes = labelled

    def count(batches: Iterator[Rows]) -> np.ndarray:
        total = [np.zeros(k) for k in sizes]
        for rows in _steps(batches):
            own = labels(rows)
            for i, k in enumerate(sizes):
                total[i] += np.bincount(own[:, i], minlength=k)
        return np.concatenate(total)

    counted = data.summed(count, sum(sizes))
    counts = np.split(counted, np.cumsum(sizes)[:-1])
    sets = _anchors(data, labels, sizes, counts, anchors, seed)

    def score(batches: Iterator[Rows]) -> np.ndarray:
        total = np.zeros((len(sizes), PARTS + 1))
        for rows in _steps(batches):
            own = labels(rows)
            for i, (k, given) in enumerate(zip(sizes, sets)):
                middle = given.points.mean(0) if len(given.points) and rows.dense is not None else np.zeros(rows.width)
                far = np.sqrt(distances(moved(rows, middle), given.points - middle))
                order = np.argsort(given.rows, kind="stable")
                at = np.searchsorted(given.rows[order], rows.others["row"])
                itself = np.flatnonzero(given.rows[order[np.minimum(at, len(order) - 1)]] == rows.others["row"])
                self_at = order[at[itself]]
                far[itself, self_at] = 0.0
                cuts = given.cells()
                padded = np.concatenate([far, np.zeros((len(rows), 1))], 1)
                sums = np.add.reduceat(padded, cuts[:-1], axis=1)
                sums[:, cuts[:-1] == cuts[1:]] = 0.0
                numbers = np.broadcast_to(np.diff(cuts).astype(np.float64), sums.shape).copy()
                numbers[itself, given.cluster[self_at] * PARTS + given.part[self_at]] -= 1
                sums, numbers = (x.reshape(len(rows), k, PARTS) for x in (sums, numbers))
                whole = sums.sum(2), numbers.sum(2)
                total[i, 0] += _silhouettes(*whole, own[:, i]).sum()
                for part in range(PARTS):
                    less = [x - np.where(given.sampled, y[:, :, part], 0.0) for x, y in zip(whole, (sums, numbers))]
                    total[i, 1 + part] += _silhouettes(*less, own[:, i]).sum()
        return total

    totals = data.summed(score, len(sizes) * (PARTS + 1)).reshape(len(sizes), PARTS + 1)
    out = []
    for total, own in zip(totals, counts):
        n = max(own.sum(), 1)
        parts = total[1:] / n
        spread = float(np.sqrt((PARTS - 1) / PARTS * np.square(parts - parts.mean()).sum()))
        bias = (PARTS - 1) * abs(float(parts.mean() - total[0] / n))
        error = 2.0 * (spread + bias)
        out.append(Score(float(total[0] / n), error if (own > anchors).any() else 0.0, int(own.sum())))
    return out


def _numbered(df: DataFrame, column: str, label: str) -> tuple[Vectors, int]:
    """The vectors with the number of their label; rows without one are left out. Labels are few: one a cluster."""
    levels = sorted(row[0] for row in df.select(label).where(F.col(f"`{label}`").isNotNull()).distinct().collect())
    number = F.array_position(F.array(*[F.lit(x) for x in levels]), F.col(f"`{label}`")) - 1 if levels else F.lit(None)
    rows = df.select(F.col(f"`{column}`").alias("v"), number.cast("int").alias("label")).where("label is not null")
    return vectors(rows, "v", ["label"], "silhouette"), len(levels)


def _given(rows: Rows) -> np.ndarray:
    return rows.others["label"][:, None].astype(np.int64)


def euclidean_silhouette(
    df: DataFrame, column: str = "features", label: str = "cluster", anchors: int = ANCHORS, seed: int = 42, exact: bool = False
) -> DataFrame:
    """Mean Euclidean silhouette of a labelling as one row: silhouette, error, n_rows.

    By anchors, see ``euclidean_silhouettes``; with ``exact`` over all pairs, in blocks of ``BLOCK_ROWS`` rows: a scan
    and a written table of sums a block, so its work grows with the square of the rows. Rows without vector or label are
    left out; one cluster, or none, gives 0.
    """
    data, k = _numbered(df, column, label)
    schema = "silhouette double, error double, n_rows long"
    if not k:
        return df.sparkSession.createDataFrame([(0.0, 0.0, 0)], schema)
    score = _exact(data, k) if exact else euclidean_silhouettes(data, (_given, [k]), anchors, seed)[0]
    return df.sparkSession.createDataFrame([(score.mean, score.error, score.n_rows)], schema)


def _exact(data: Vectors, k: int) -> Score:
    """Sums of distances to every cluster, block by block of rows, added up by row."""
    n = data.table.count()
    blocks = max(-(-n // BLOCK_ROWS), 1)
    parts = None
    for number in range(blocks):
        block = replace(data, table=data.table.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == number))
        points, rows, own = _collected(block)

        def task(batches: Iterator[Rows]) -> Iterator[pa.RecordBatch]:
            member = np.zeros((len(own), k))
            member[np.arange(len(own)), own] = 1.0
            for batch in _steps(batches):
                middle = points.mean(0) if len(points) and batch.dense is not None else np.zeros(batch.width)
                far = np.sqrt(distances(moved(batch, middle), points - middle))
                far[batch.others["row"][:, None] == rows[None, :]] = 0.0
                columns = batch.others["row"], batch.others["label"], list(far @ member)
                kinds = pa.int64(), pa.int32(), pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["row", "label", "sums"])

        part = stage(data.batches(task, "row long, label int, sums array<double>"), "distances")
        parts = part if parts is None else parts.unionByName(part)
    sizes = data.table.groupBy("label").agg(F.count("*").alias("n")).collect()
    counts = [next((float(r["n"]) for r in sizes if r["label"] == c), 0.0) for c in range(k)]
    total = parts.groupBy("row", "label").agg(*[F.sum(F.col("sums")[c]).alias(f"s{c}") for c in range(k)])
    own = F.element_at(F.array(*[F.col(f"s{c}") for c in range(k)]), F.col("label") + 1)
    size = F.element_at(F.array(*[F.lit(x) for x in counts]), F.col("label") + 1)
    inside = F.when(size > 1, own / (size - 1))
    means = [F.when(F.col("label") != c, F.col(f"s{c}") / counts[c]) for c in range(k) if counts[c]]
    outside = F.array_min(F.array_compact(F.array(*means)))
    value = F.coalesce(F.try_divide(outside - inside, F.greatest(outside, inside)), F.lit(0.0))
    mean = total.agg(F.avg(value)).first()[0]
    return Score(float(mean or 0.0), 0.0, n)


def _collected(block: Vectors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points, row numbers and labels of one block."""

    def task(batches: Iterator[Rows]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            points = rows.dense if rows.dense is not None else rows.weighted(np.eye(len(rows)))
            columns = list(points), rows.others["row"], rows.others["label"]
            kinds = pa.list_(pa.float64()), pa.int64(), pa.int32()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["point", "row", "label"])

    found = block.batches(task, "point array<double>, row long, label int").collect()
    points = np.array([r["point"] for r in found]).reshape(len(found), block.width)
    return points, np.array([r["row"] for r in found], np.int64), np.array([r["label"] for r in found], np.int64)


by_value(__name__)
