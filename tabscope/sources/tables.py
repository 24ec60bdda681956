"""CSV and literal sources, Parquet and CSV sinks."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType

from tabscope.functions.numbers import NUMBER
from tabscope.functions.text import normalize_key
from tabscope.session import stage

# The texts that count as a missing value when a CSV is read.
NA_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_csv_table(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType,
    na_values: Sequence[str] = NA_VALUES,
    multi_line: bool = False,
) -> DataFrame:
    """CSV with a header row; texts in ``na_values`` become NULL and a malformed number fails the read.

    The header must agree with ``schema``. Columns are read as text so that codes keep their leading zeros, and cast
    to the declared types afterwards. ``multi_line`` is needed only for quoted line breaks: it makes files
    unsplittable.
    """
    as_text = StructType([StructField(field.name, StringType()) for field in schema])
    raw = spark.read.csv(
        path, schema=as_text, header=True, multiLine=multi_line, enforceSchema=False, escape='"', mode="FAILFAST"
    )
    return raw.select(
        *[
            F.when(~F.col(f"`{field.name}`").isin(*na_values), F.col(f"`{field.name}`"))
            .cast(field.dataType)
            .alias(field.name)
            for field in schema
        ]
    )


WHOLE = r"^\s*[+-]?\d+\s*$"
CODE = r"^\s*[+-]?0\d"
# Texts of booleans and of infinite numbers.
TRUTH = r"^(True|TRUE|true|False|FALSE|false)$"
INFINITE = r"(?i)^\s*[+-]?inf(inity)?\s*$"
LINE, FILE = "__line", "__file"


@dataclass(frozen=True)
class CsvTable:
    """The accepted rows of a CSV source, its types, and a row per problem: file, line, column, value, reason."""

    table: DataFrame
    schema: StructType
    rejected: DataFrame


def infer_types(raw: DataFrame, columns: Sequence[str], keep_codes: bool = False) -> StructType:
    """The narrowest of boolean, long, double and string that holds every present text of each column.

    All columns share one aggregate of counts by form, combined map-side: the type of the whole is that of its parts
    put together, so every row counts, in any order. Whole numbers beyond 64 bits stay text; a column without any
    text is double. With ``keep_codes`` numbers with leading zeros are text, as codes are.
    """
    counts = []
    for i, name in enumerate(columns):
        text = F.col(f"`{name}`")
        whole, finite = text.rlike(WHOLE), text.rlike(NUMBER)
        forms = {
            "n": text.isNotNull(),
            "whole": whole,
            "long": whole & F.trim(text).try_cast("long").isNotNull(),
            "number": finite | text.rlike(INFINITE),
            "truth": text.rlike(TRUTH),
            "code": finite & text.rlike(CODE),
        }
        counts += [F.count_if(form).alias(f"{key}{i}") for key, form in forms.items()]
    row = raw.agg(*counts).first() if columns else {}

    def kind(i: int) -> DataType:
        n, whole, long, number, truth, code = (row[f"{key}{i}"] for key in ("n", "whole", "long", "number", "truth", "code"))
        if n and truth == n:
            return BooleanType()
        if number < n or (keep_codes and code) or (n and whole == n > long):
            return StringType()
        return LongType() if n and long == n else DoubleType()

    return StructType([StructField(name, kind(i)) for i, name in enumerate(columns)])


def _typed(text: Column, kind: DataType) -> Column:
    """The text as ``kind``; NULL where it is missing or of another form."""
    name = kind.simpleString()
    if name == "string":
        return text
    if name in ("double", "float"):
        return F.when(text.rlike(NUMBER) | text.rlike(INFINITE), F.trim(text).try_cast(kind))
    return F.trim(text).try_cast(kind)


def read_csv_checked(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType | None = None,
    na_values: Sequence[str] = NA_VALUES,
    multi_line: bool = False,
    keep_codes: bool = False,
) -> CsvTable:
    """CSV with a header row that may hold bad lines: they are counted and kept, and the other rows are read.

    Without ``schema`` the columns of the header get the types of ``infer_types`` over all well-formed lines. A line with
    another number of fields, or with a text that is not of its column's type, is left out of ``table``; ``rejected``
    says where and why, with a row per bad value. A header other than ``schema`` fails. The texts are written once, so
    each file is parsed once.
    """
    header = spark.read.csv(path, header=True, multiLine=multi_line, escape='"').columns
    columns = header if schema is None else schema.names
    if header != columns:
        raise ValueError(f"the header is {header}, expected {columns}")
    as_text = StructType([*[StructField(name, StringType()) for name in columns], StructField(LINE, StringType())])
    raw = spark.read.csv(
        path, schema=as_text, header=True, multiLine=multi_line, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=LINE
    )
    present = [F.when(~F.col(f"`{name}`").isin(*na_values), F.col(f"`{name}`")).alias(name) for name in columns]
    raw = stage(raw.select(*present, LINE, F.col("_metadata.file_path").alias(FILE)), "csv")
    whole = raw.where(F.col(LINE).isNull())
    schema = schema or infer_types(whole, columns, keep_codes)
    values = {field.name: _typed(F.col(f"`{field.name}`"), field.dataType) for field in schema}
    bad = {name: F.col(f"`{name}`").isNotNull() & value.isNull() for name, value in values.items()}
    any_bad = F.lit(False)
    for condition in bad.values():
        any_bad = any_bad | condition
    table = whole.where(~any_bad).select(*[value.cast(schema[name].dataType).alias(name) for name, value in values.items()])
    problems = [
        F.when(
            condition,
            F.struct(
                F.lit(name).alias("column"),
                F.col(f"`{name}`").alias("value"),
                F.lit(f"not a {schema[name].dataType.simpleString()}").alias("reason"),
            ),
        )
        for name, condition in bad.items()
    ]
    line = F.to_csv(F.struct(*[F.col(f"`{name}`") for name in columns]))
    wrong = whole.where(any_bad).select(F.col(FILE).alias("file"), line.alias("line"), F.explode(F.array_compact(F.array(*problems))).alias("x"))
    broken = raw.where(F.col(LINE).isNotNull()).select(
        F.col(FILE).alias("file"),
        F.col(LINE).alias("line"),
        F.lit(None).cast("string").alias("column"),
        F.lit(None).cast("string").alias("value"),
        F.lit("number of fields").alias("reason"),
    )
    return CsvTable(table, schema, broken.unionByName(wrong.select("file", "line", "x.column", "x.value", "x.reason")))


def literal_dimension(
    spark: SparkSession,
    rows: Sequence[tuple],
    schema: StructType | str,
    constants: Mapping[str, Any] | None = None,
    key: tuple[str, str] | None = None,
    articles: Sequence[str] = (),
) -> DataFrame:
    """A small inline table with constant columns; ``key=(source, name)`` adds its normalised key."""
    table = spark.createDataFrame(list(rows), schema)
    table = table.withColumns({name: F.lit(value) for name, value in (constants or {}).items()})
    if key is not None:
        source, name = key
        table = table.withColumn(name, normalize_key(F.col(source), articles))
    return table


# The UTF-8 mark that spreadsheet programs look for.
MARK = "\ufeff"


def _files(spark: SparkSession, path: str):
    """The file system of a path, and its path type."""
    kind = spark._jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(spark._jsc.hadoopConfiguration()), kind


def _swap(spark: SparkSession, new: str, path: str) -> None:
    """Put a finished table in the place of ``path``; what was there is deleted last, and put back if that fails."""
    files, kind = _files(spark, path)
    old = f"{path}.old-{uuid.uuid4().hex}"
    replaced = files.exists(kind(path))
    if replaced and not files.rename(kind(path), kind(old)):
        raise OSError(f"{path} cannot be moved aside; the new table is at {new}")
    if not files.rename(kind(new), kind(path)):
        if replaced:
            files.rename(kind(old), kind(path))
        raise OSError(f"{new} cannot be moved to {path}")
    if replaced:
        files.delete(kind(old), True)


def recover_table(spark: SparkSession, path: str) -> bool:
    """After a driver died inside ``write_table``: put back the table that was moved aside, and delete unfinished ones.

    Whether ``path`` holds a table afterwards.
    """
    path = path.rstrip("/")
    files, kind = _files(spark, path)
    for part in ("old", "new"):
        for status in files.globStatus(kind(f"{path}.{part}-*")) or []:
            if part == "old" and not files.exists(kind(path)):
                files.rename(status.getPath(), kind(path))
            else:
                files.delete(status.getPath(), True)
    return files.exists(kind(path))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", mark: bool = False) -> str:
    """Persist one table as Parquet (default) or CSV with a header; returns the path.

    An overwrite writes the new table aside and swaps it in when it is complete. A job that fails or is killed
    leaves the old table, and a table may be read from the path it is written to. Between the two renames of the swap
    the path is empty; ``recover_table`` mends a driver's death there. ``mark`` puts the UTF-8 mark before each CSV file.
    """
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown table format: {fmt}")
    spark, path = df.sparkSession, path.rstrip("/")
    if fmt == "csv" and mark and df.columns:
        df = df.toDF(MARK + df.columns[0], *df.columns[1:])
    target = f"{path}.new-{uuid.uuid4().hex}" if mode == "overwrite" else path
    writer = df.write.mode("errorifexists" if mode == "overwrite" else mode)
    try:
        if fmt == "parquet":
            writer.parquet(target)
        else:
            writer.csv(target, header=True, escape='"')
    except Exception:
        if mode == "overwrite":
            files, kind = _files(spark, target)
            files.delete(kind(target), True)
        raise
    if mode == "overwrite":
        _swap(spark, target, path)
    return path


def write_report_bundle(
    tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet", mode: str = "overwrite"
) -> dict[str, str]:
    """Persist a named set of result tables, one directory per name; returns name -> path."""
    return {name: write_table(df, f"{path}/{name}", fmt, mode) for name, df in tables.items()}


def read_report_bundle(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(path) for name, path in paths.items()}


