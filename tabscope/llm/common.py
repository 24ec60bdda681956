"""What the operators share: tasks shipped by value, Arrow rows, staged tables, small-or-shuffled semi joins."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabscope.session import stage

# A list of keys within this many rows (8 bytes each and its overhead) is sent to every task; a longer one is shuffled.
BROADCAST_KEYS = 1_000_000
# Bytes of a batch that a task turns into Python values at a time; a single longer row is taken alone.
BATCH_BYTES = 2 << 20
# The same where a task keeps lists of the words of all its texts.
WORD_BATCH_BYTES = 1 << 19
# Rows of an Arrow batch at most: with Spark's 10,000 the buffers of one batch of texts, on both sides of a task, take tens of MB.
BATCH_ROWS, BATCH_SETTING = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"
# Bytes of an Arrow batch, about, so that long texts do not make large buffers either.
ARROW_BYTES, BYTES_SETTING = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def by_value(*names: str) -> None:
    """Ship the task functions of these modules inside the tasks, so that executors need no copy of this package."""
    for name in names:
        cloudpickle.register_pickle_by_value(sys.modules[name])


by_value(__name__)


def give_back() -> None:
    """Return freed memory to the system: workers are reused, and what one task freed would stay with the process."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this system's way
        pass


def map_rows(
    df: DataFrame,
    schema: str,
    task: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]],
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """Run ``task`` over batches of columns (name to list of values), in Arrow batches inside each partition.

    The session's Arrow batches are held to about ``ARROW_BYTES`` bytes and, unless it has smaller ones, to ``BATCH_ROWS`` rows
    from then on. ``task`` gets them in parts of at most ``batch_bytes`` bytes or one row.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        conf.set(BATCH_SETTING, BATCH_ROWS)
    conf.set(BYTES_SETTING, ARROW_BYTES)
    declared = StructType.fromDDL(schema)
    arrow = _arrow_schema(df, declared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (part for batch in batches for part in _slices(batch, batch_bytes))
        columns = ({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)} for part in parts)
        for out in task(columns):
            yield pa.RecordBatch.from_arrays([pa.array(out[field.name], field.type) for field in arrow], schema=arrow)
        del columns, parts
        give_back()

    return df.mapInArrow(run, declared)


def _slices(batch: pa.RecordBatch, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in halves of halves, until each holds at most ``most`` bytes or one row."""
    if batch.num_rows < 2 or batch.nbytes <= most:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from _slices(batch.slice(0, half), most)
        yield from _slices(batch.slice(half), most)


def listed(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a table, as ``createDataFrame`` gives it.

    They go as an Arrow table: a list of tuples passes Python workers that run no other step, and which then stay with each executor.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    columns = zip(*rows) if rows else [()] * len(arrow)
    arrays = [pa.array(column, field.type) for column, field in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema)


def _arrow_schema(df: DataFrame, declared: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(declared)


def texts_of(df: DataFrame, key: str, text: str, valid: bool = False) -> DataFrame:
    """Only the key and the UTF-8 bytes of the text, so that other columns (also of clashing names) play no part.

    With ``valid``, bytes that are no UTF-8 become the replacement character; else they are given as they are.
    """
    value = F.col(f"`{text}`")
    value = F.make_valid_utf8(value.cast("string")) if valid else value
    return df.select(F.col(f"`{key}`").alias("key"), value.cast("binary").alias("text"))


def _joined(df: DataFrame, keys: DataFrame, on: list[str], rows: int, how: str) -> DataFrame:
    right = keys.select(*[F.col(name).alias(f"__{name}") for name in on])
    match = [F.col(name).eqNullSafe(F.col(f"__{name}")) for name in on]
    return df.join(F.broadcast(right) if rows <= BROADCAST_KEYS else right, match, how)


def semi(df: DataFrame, keys: DataFrame, on: list[str], rows: int) -> DataFrame:
    """Rows of ``df`` whose ``on`` columns occur in ``keys``.

    ``rows`` is the measured number of keys: a list within ``BROADCAST_KEYS`` goes to every task, so that long texts
    need no shuffle; a longer one is joined by shuffle. Both give the same rows.
    """
    return _joined(df, keys, on, rows, "left_semi")


def except_rows(df: DataFrame, keys: DataFrame, on: list[str], rows: int) -> DataFrame:
    """Rows of ``df`` whose ``on`` columns do not occur in ``keys``; see ``semi``."""
    return _joined(df, keys, on, rows, "left_anti")


def staged(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back: it cuts the lineage and survives lost executors."""
    return stage(df, name)
