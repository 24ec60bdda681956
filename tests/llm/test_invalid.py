"""Texts with bytes that are no UTF-8: each operator reads them as if they held the replacement character."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tabscope.llm import decontaminate, language, packing, secrets, tokens

from .conftest import prose

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def pair(spark):
    """The same texts with the bytes themselves and with the character that stands for them."""
    body = [f"{prose(1, 30)} ? {prose(2, 30)}", "password=?abcdefgh12", "?"]
    whole = spark.createDataFrame([(i, text) for i, text in enumerate(body)], "doc_id long, text string").coalesce(1)
    raw = F.expr("cast(unhex(replace(hex(text), '3F', 'FF')) as string)")
    return whole.withColumn("text", raw), whole.withColumn("text", F.replace(F.col("text"), F.lit("?"), F.lit("�")))


def same(operator, pair):
    rows = [sorted(map(tuple, operator(df).collect()), key=str) for df in pair]
    assert rows[0] == rows[1] and rows[0]


def test_tokens_and_pieces(pair):
    same(lambda df: tokens.count_tokens(df, WORDS), pair)
    same(lambda df: packing.token_pieces(df, WORDS, 64), pair)


def test_secrets(pair):
    same(lambda df: secrets.scan_secrets(df, *RANKS), pair)
    same(lambda df: secrets.redact_secrets(df, *RANKS), pair)


def test_contaminated(pair):
    items = pair[1].select(F.col("doc_id").alias("item_id"), "text").where("doc_id = 0")
    same(lambda df: decontaminate.contaminated(df, items), pair)


def test_languages(spark, pair):
    learned = spark.createDataFrame([(i, prose(i, 50), "en") for i in range(5)], "doc_id long, text string, lang string")
    model = language.train_language_model(learned)
    same(lambda df: language.identify_languages(df, model), pair)
    levels = language.explained_levels(learned, model)
    same(lambda df: language.explained_shares(df, model, levels), pair)
