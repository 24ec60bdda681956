"""The corpus pipeline: language ID, near duplicates, decontamination, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns the rows for the next one, with the columns of documents; the last
returns packed pieces. Between stages the rows are written as Parquet and read back. In every stage an empty table gives
no rows, bytes that are no UTF-8 count as the replacement character, repeated rows are judged one by one, and other columns
stay, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.llm import decontaminate, jaccard, language, secrets
from tabscope.llm.common import except_rows, listed, staged
from tabscope.llm.queries import BYTE_RANKS, fold, packed, table

# A text is rejected if the languages of its spans, taken together, explain a smaller share of its words.
LEAST_EXPLAINED = 1 / 3


# Distinct chunks that the packing stage remembers, which runs beside what the other stages have left in the executors.
REMEMBERED_CHUNKS = 200_000
# Rows of one file; files are numbered above.
ROWS_PER_FILE = 1 << 40


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have, whatever the case of its letters."""
    taken = {column.lower() for column in docs.columns}
    while name in taken or f"__{name}" in taken:
        name += "_"
    return name


def _numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` with an id of each row in a column of a free name, and that name.

    Rows of a Parquet table are told by their file and their place in it, which every reader sees alike, so no copy is made. The
    driver holds the files' names, as Spark's own list of files does. Any other table is numbered and written once.
    """
    row, path, place = (_free(docs, part) for part in ("row", "row_file", "row_place"))
    try:
        hidden = F.col("_metadata.file_path"), F.col("_metadata.row_index")
        known = docs.withColumns({path: hidden[0], place: hidden[1]}) if "_metadata" not in docs.columns else None
        files = sorted(found[0] for found in known.select(path).distinct().collect()) if known else None
    except AnalysisException:  # not read from files
        files = None
    if files is None:
        return staged(docs.withColumn(row, F.monotonically_increasing_id()), f"{name}-rows"), row
    numbers = listed(docs.sparkSession, list(zip(files, range(len(files)))), f"{path} string, {row} long")
    numbered = known.join(F.broadcast(numbers), path, "left")
    numbered = numbered.withColumn(row, F.col(row) * ROWS_PER_FILE + F.col(place))
    return numbered.select(*[F.col(f"`{column}`") for column in docs.columns], row), row


def _keep(rows: DataFrame, rejected: DataFrame, row: str, name: str) -> DataFrame:
    """Numbered rows whose id is not in ``rejected``, without it: each row stands for itself, whatever its key."""
    ids = staged(rejected.select(row).distinct(), name)
    return except_rows(rows, ids, [row], ids.count()).drop(row)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in learned languages, one or several; those without a letter, or of none, go.

    Missing and empty texts have no letter. Languages and their levels are learned from all labelled documents but those that
    op10 holds out by their keys; documents without a key are learned from. The spans of each text are identified; a word
    counts if its n-grams are as likely in the language of its span as those of the words which that was learned from.
    """
    (rows, row), learned = _numbered(docs, "language"), docs.where(~F.coalesce(fold(docs), F.lit(False)))
    model = language.train_language_model(learned)
    found = language.identify_languages(rows, model, key=row, levels=language.explained_levels(learned, model))
    return _keep(rows, found.where(F.col("explained") < LEAST_EXPLAINED), row, "rejected-language")


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates; texts without words have none.

    It is that of the smallest key, NULL last, and of the smallest row id among rows of that key.
    """
    rows, row = _numbered(docs, "duplicates")
    groups = staged(jaccard.jaccard_components(rows, key=row), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", row))[row]
    kept = groups.join(rows.select(row, "doc_id"), row).groupBy("component_id").agg(first.alias(row))
    return _keep(rows, groups.join(staged(kept.select(row), "kept"), row, "left_anti"), row, "duplicates")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item; missing and empty texts hold none, and nothing if there is no item."""
    rows, row = _numbered(docs, "decontamination")
    found = decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark"), key=row)
    return _keep(rows, found, row, "contaminated")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts masked; the masked length becomes their n_chars; missing ones stay missing."""
    masked = secrets.redact_secrets(docs, public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)
    length = F.char_length("text").cast("long")
    return masked.withColumn("n_chars", length) if "n_chars" in docs.columns else masked


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; a missing or empty text has its end mark alone."""
    return packed(docs, REMEMBERED_CHUNKS)


STAGES = [
    ("language_id", language_stage),
    ("jaccard_join", duplicates_stage),
    ("decontamination", decontamination_stage),
    ("secret_scans", secrets_stage),
    ("packing", packing_stage),
]

# Language ID, alignment and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
