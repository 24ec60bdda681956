"""Principal components of dense or sparse rows by block Krylov sums, and projections on them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tabscope.operators.lloyd import middle, moved
from tabscope.operators.sums import DENSE_WIDTH, Rows, Vectors, _batch, by_value, vectors

# Columns of a block beyond the components that are wanted, and scans at most.
OVERSAMPLE, MAX_SCANS = 8, 60


@dataclass(frozen=True)
class Components:
    """Mean of the rows, loadings (width x components), variance share of each, and the scans it took."""

    mean: np.ndarray
    loadings: np.ndarray
    shares: tuple[float, ...]
    scans: int


def principal_components(data: Vectors, k: int = 2, tolerance: float = 1e-9, seed: int = 42) -> Components:
    """The first ``k`` principal components, to a residual of ``tolerance`` times the largest variance.

    One scan multiplies the covariance with a block of ``k`` + OVERSAMPLE columns: rows are multiplied by the block and
    added up by the products, so neither a width x width matrix nor centred rows are made. The blocks span a Krylov space, kept
    orthogonal on the driver, which holds some dozens of columns of the width. Narrow rows are exact after a few scans, as
    the blocks span everything. Wide sparse rows stay sparse: their mean is taken off the products instead of the rows. The
    largest loading of each component is positive; components that the data does not have are 0.
    """
    width, mean = data.width, sparse_mean(data)
    shift = mean if width <= DENSE_WIDTH else np.zeros(width)

    def multiplied(block: np.ndarray) -> tuple[np.ndarray, float, int]:
        l = block.shape[1]

        def task(batches: Iterator[Rows]) -> np.ndarray:
            total = np.zeros(l * width + 2)
            products = total[:-2].reshape(l, width)
            for rows in batches:
                rows = moved(rows, shift)
                rows.add_to(products, rows.dot(block))
                total[-2] += rows.squares().sum()
                total[-1] += len(rows)
            return total

        total = data.summed(task, l * width + 2)
        n, off = int(total[-1]), mean - shift
        product = total[:-2].reshape(l, width).T - n * np.outer(off, off @ block)
        return product / max(n - 1, 1), (total[-2] - n * float(off @ off)) / max(n - 1, 1), n

    rng = np.random.default_rng(seed)
    block = np.linalg.qr(rng.standard_normal((width, min(k + OVERSAMPLE, width))))[0]
    basis, images, scans = np.zeros((width, 0)), np.zeros((width, 0)), 1
    vectors_, values, variance = np.zeros((width, 0)), np.zeros(0), 0.0
    while block.shape[1] and scans < MAX_SCANS:
        product, variance, _ = multiplied(block)
        scans += 1
        basis, images = np.concatenate([basis, block], 1), np.concatenate([images, product], 1)
        small = basis.T @ images
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1][:k], turns[:, ::-1][:, :k]
        vectors_ = basis @ turns
        left = np.linalg.norm(images @ turns - vectors_ * values, axis=0)
        if len(values) == min(k, width) and left.max(initial=0.0) <= tolerance * max(values[0], 0.0):
            break
        for _ in range(2):
            product = product - basis @ (basis.T @ product)
        u, sizes, _ = np.linalg.svd(product, full_matrices=False)
        block = u[:, sizes > 1e-12 * max(variance, 1e-300)]
        block = block[:, : max(width - basis.shape[1], 0)]
    values = np.where(values > 1e-14 * max(variance, 1e-300), values, 0.0)
    loadings = np.zeros((width, k))
    found = np.flatnonzero(values > 0)
    loadings[:, found] = vectors_[:, found]
    for i in range(k):
        if width and loadings[np.abs(loadings[:, i]).argmax(), i] < 0:
            loadings[:, i] *= -1.0
    shares = [float(value / variance) if variance > 0 else 0.0 for value in values]
    return Components(mean, loadings, tuple(shares + [0.0] * (k - len(shares))), scans)


def sparse_mean(data: Vectors) -> np.ndarray:
    """The mean of the rows, whatever their width."""
    if data.width <= DENSE_WIDTH:
        return middle(data)
    width = data.width

    def task(batches: Iterator[Rows]) -> np.ndarray:
        total = np.zeros(width + 1)
        for rows in batches:
            np.add.at(total, rows.indices, rows.values)
            total[-1] += len(rows)
        return total

    total = data.summed(task, width + 1)
    return total[:-1] / max(total[-1], 1)


def fit_components(df: DataFrame, column: str = "features", k: int = 2) -> Components:
    """``principal_components`` of a vector column."""
    return principal_components(vectors(df, column, name="pca"), k)


def project(df: DataFrame, model: Components, column: str, keep: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``keep`` columns and the centred place of each row on each component; NULL without a vector."""
    loadings, offset, width = model.loadings, model.mean @ model.loadings, len(model.mean)
    given = df.select(*[F.col(f"`{name}`").alias(f"k{i}") for i, name in enumerate(keep)], F.unwrap_udt(f"`{column}`").alias("v"))
    given = given.select(*[f"k{i}" for i in range(len(keep))], "v.type", "v.indices", "v.values")
    schema = StructType([*given.schema.fields[: len(keep)]])
    for i in range(len(names)):
        schema = schema.add(f"p{i}", "double")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            present = batch.column("values").is_valid()
            filled = batch.filter(present)
            parts = [rows.dot(loadings) - offset for rows in _batch(filled, width, ())] if filled.num_rows else []
            places = np.full((batch.num_rows, len(names)), np.nan)
            if parts:
                places[present.to_numpy(zero_copy_only=False)] = np.concatenate(parts)
            own = [pa.array(places[:, i], from_pandas=True) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: arrow.names.index("p0")], *own], schema=arrow)

    found = given.mapInArrow(run, schema)
    return found.select(
        *[F.col(f"k{i}").alias(name) for i, name in enumerate(keep)], *[F.col(f"p{i}").alias(name) for i, name in enumerate(names)]
    )


by_value(__name__)
