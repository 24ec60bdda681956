"""Sums over the rows of a vector column, one scan each: what iterative fits repeat until they are done."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.session import stage

# Numbers in one row of a partial sum: longer sums are cut, so that many tasks add them up.
SLICE = 4096
# Numbers that the driver adds up itself.
DIRECT = 1 << 21
# Cells of a dense matrix, or non-zero cells of a sparse one, that a task works on at a time.
CELLS = 1 << 20


def by_value(*names: str) -> None:
    """Ship the task functions of these modules inside the tasks, so that executors need no copy of this package."""
    for name in names:
        cloudpickle.register_pickle_by_value(sys.modules[name])


@dataclass
class Rows:
    """Rows of one batch, dense as a matrix or sparse by rows, and their other columns."""

    width: int
    dense: np.ndarray | None
    starts: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    others: dict[str, np.ndarray]

    def __len__(self) -> int:
        return len(self.starts) - 1

    def dot(self, matrix: np.ndarray) -> np.ndarray:
        """Rows times ``matrix`` (width x m)."""
        if self.dense is not None:
            return self.dense @ matrix
        out = np.zeros((len(self), matrix.shape[1]))
        filled = np.flatnonzero(np.diff(self.starts))
        if len(filled):
            products = matrix[self.indices] * self.values[:, None]
            out[filled] = np.add.reduceat(products, self.starts[filled], axis=0)
        return out

    def weighted(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the rows by weights (rows x m): m x width."""
        return self.add_to(np.zeros((weights.shape[1], self.width)), weights)

    def add_to(self, total: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """``total`` (m x width) with the sum of the rows by weights added; sparse rows touch their own columns alone."""
        if self.dense is not None:
            total += weights.T @ self.dense
        elif len(self.indices):
            order = np.argsort(self.indices, kind="stable")
            row = np.repeat(np.arange(len(self)), np.diff(self.starts))[order]
            columns = self.indices[order]
            first = np.flatnonzero(np.r_[True, columns[1:] != columns[:-1]])
            total.T[columns[first]] += np.add.reduceat(weights[row] * self.values[order][:, None], first, axis=0)
        return total

    def squares(self) -> np.ndarray:
        """Squared length of each row."""
        if self.dense is not None:
            return np.einsum("ij,ij->i", self.dense, self.dense)
        cells = np.r_[0.0, np.cumsum(self.values * self.values)]
        return cells[self.starts[1:]] - cells[self.starts[:-1]]


# Up to this width sparse rows are worked on as a dense matrix, in pieces of CELLS.
DENSE_WIDTH = 1024


def _batch(batch: pa.RecordBatch, width: int, others: Sequence[str]) -> Iterator[Rows]:
    sparse = batch.column("type").to_numpy(zero_copy_only=False) == 0
    lists, names = batch.column("values"), batch.column("indices")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.r_[0, np.cumsum(sizes)]
    if sparse.all():
        indices = names.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    else:
        own = names.fill_null([]).flatten().to_numpy(zero_copy_only=False)
        indices = np.arange(len(values)) - np.repeat(starts[:-1], sizes)
        indices[np.repeat(sparse, sizes)] = own
    columns = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in others}
    step = max(CELLS // max(width if width <= DENSE_WIDTH else int(sizes.max(initial=1)), 1), 1)
    for at in range(0, len(sizes), step):
        end = min(at + step, len(sizes))
        cells = slice(starts[at], starts[end])
        own = starts[at : end + 1] - starts[at]
        dense = None
        if width <= DENSE_WIDTH:
            dense = np.zeros((end - at, width))
            dense[np.repeat(np.arange(end - at), np.diff(own)), indices[cells]] = values[cells]
        part = {name: value[at:end] for name, value in columns.items()}
        yield Rows(width, dense, own, indices[cells], values[cells], part)


@dataclass(frozen=True)
class Vectors:
    """A written table of one vector column, taken apart, with other numeric columns.

    ``width`` is the length of the vectors, ``parts`` the number of tasks of a scan.
    """

    table: DataFrame
    width: int
    others: tuple[str, ...]
    parts: int

    def batches(self, task: Callable[[Iterator[Rows]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """``task`` over the rows of each partition."""
        width, others = self.width, self.others

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return task(rows for batch in batches if batch.num_rows for rows in _batch(batch, width, others))

        return self.table.mapInArrow(run, schema)

    def summed(self, task: Callable[[Iterator[Rows]], np.ndarray], size: int) -> np.ndarray:
        """The sum over all partitions of the ``size`` numbers that ``task`` makes of each, by one scan.

        Partial sums travel in slices, which are added up by as many tasks; the driver receives one sum. While the partial
        sums of all tasks are no more than DIRECT numbers together, the driver adds them up itself and a stage is saved.
        """

        def partial(rows: Iterator[Rows]) -> Iterator[pa.RecordBatch]:
            total = np.asarray(task(rows), np.float64).ravel()
            slices = {at // SLICE: total[at : at + SLICE] for at in range(0, len(total), SLICE)}
            filled = [slot for slot, part in slices.items() if part.any()]
            parts = pa.array([slices[slot] for slot in filled], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), parts], names=["slot", "part"])

        parts = self.batches(partial, "slot int, part array<double>")
        if self.parts * size > DIRECT:
            parts = parts.groupBy("slot").agg(vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("part"))
        out = np.zeros(size)
        found = parts.toArrow()
        for slot, part in zip(found.column("slot").to_pylist(), found.column("part")):
            own = part.values.to_numpy(zero_copy_only=False)
            out[slot * SLICE : slot * SLICE + len(own)] += own
        return out


def vectors(
    df: DataFrame, column: str = "features", others: Sequence[str] = (), name: str = "vectors", width: int | None = None
) -> Vectors:
    """``column`` and numeric ``others`` of ``df`` and a row number, written once, for fits that scan them many times.

    Rows without a vector are left out. The number tells rows apart and has no order.
    """
    rows = df.select(F.unwrap_udt(f"`{column}`").alias("v"), *[F.col(f"`{x}`").alias(x) for x in others])
    rows = rows.where("v is not null").withColumn("row", F.monotonically_increasing_id())
    table = stage(rows.select("v.type", "v.size", "v.indices", "v.values", "row", *others), name)
    if width is None:
        width = table.agg(F.max(F.coalesce("size", F.size("values")))).first()[0] or 0
    table = table.drop("size")
    return Vectors(table, width, ("row", *others), table.rdd.getNumPartitions())


by_value(__name__)
