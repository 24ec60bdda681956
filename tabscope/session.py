"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

WAREHOUSE = "spark.sql.warehouse.dir"
# Paths staged inside the open ``staging`` blocks, innermost last.
_SCOPES: list[list[str]] = []
# Where each staged table lies, for ``unstage``.
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def local_session(cores: int | str = "*", app: str = "tabscope", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session the cluster provides."""
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables: ``spark.checkpoint.dir``, else the context's own, else the warehouse.

    On a cluster the warehouse counts only if it was set, as its default is a folder of one machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured and not context.master.startswith("local") and not context.getConf().contains(WAREHOUSE):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (configured or spark.conf.get(WAREHOUSE)).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch folder."""
    return f"{scratch_dir(spark)}/tabscope/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Delete the tables staged inside the block when it ends: take out what you need of lazy results before."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _delete(spark, path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the scratch folder and read it back; see ``staging`` for its end.

    Used before iterative work (model sweeps), so that every pass scans the pruned table instead of
    re-running the joins above it, and a lost executor only costs a re-read.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables after their last reader; results that still read them lazily fail from then on."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path is not None:
            _delete(table.sparkSession, path)
            for scope in _SCOPES:
                if path in scope:
                    scope.remove(path)
