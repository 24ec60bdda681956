import random
import resource
import string
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabscope.llm.common import give_back
from tabscope.llm.tokens import ChunkEncoder, count_tokens, length_histogram, length_quantile

ODD = [
    "a <|endoftext|> b <|EndOfText|>", "İstanbul ΟΔΟΣ ΟΔΟΣ. x", "café ≮ é don't I'LL \x1c x\x1cy 　 z\xa0q\x85r", "\x01 a\x01b",
    "it's 's ''s 2.0 10,5", "", " \n ", "word" * 100, "̀ a ̀",
]


def test_ids_equal_those_of_the_whole_text(tokenizer_path):
    tokenizer, encoder = Tokenizer.from_file(tokenizer_path), ChunkEncoder(tokenizer_path)
    for text, chunks in zip(ODD, encoder.encode([text.encode() for text in ODD])):
        raw = b"".join(chunks)
        ids = [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_nothing_stays_when_an_encoder_is_gone(tokenizer_path):
    rng = random.Random(6)
    words = ["".join(rng.choices(string.ascii_lowercase, k=8)) for _ in range(30_000)]
    texts = [" ".join(words).encode(), " ".join(f"{word}'s" for word in words).encode()]

    def resident():
        give_back()
        return int(Path("/proc/self/statm").read_text().split()[1]) * resource.getpagesize() / 1e6

    sizes = []
    for _ in range(16):
        ChunkEncoder(tokenizer_path).encode(texts)
        sizes.append(resident())
    assert sizes[-1] - sizes[3] < 12, sizes


def brute(lengths):
    return sorted(
        (
            limit,
            lengths.count(limit),
            sum(x <= limit for x in lengths),
            sum(x for x in lengths if x <= limit),
            sum(x > limit for x in lengths),
            sum(min(x, limit) for x in lengths),
            sum(x <= limit for x in lengths) / len(lengths),
        )
        for limit in set(lengths)
    )


def test_histogram_answers_every_limit(spark):
    lengths = [0, 0, 1, 3, 3, 7, 8, 9, 20, 63, 64, 65, 500, 4096, 70_000]
    df = spark.createDataFrame([(x,) for x in lengths] + [(None,)], "n_tokens long")
    for block in (2, 8, 1024):
        histogram = length_histogram(df, block=block)
        assert sorted(map(tuple, histogram.collect())) == brute([*lengths, 0])
    assert length_quantile(histogram, 0.5).first()[0] == 8
    assert length_histogram(df.limit(0)).collect() == []


def test_counts_of_documents(messy, messy_rows, tokenizer_path, no_documents):
    tokenizer = Tokenizer.from_file(tokenizer_path)
    want = Counter((row[0], len(tokenizer.encode(row[1] or "", add_special_tokens=False).ids)) for row in messy_rows)
    counted = count_tokens(messy, tokenizer_path)
    assert Counter(map(tuple, counted.collect())) == want
    histogram = length_histogram(counted)
    assert histogram.agg(F.sum("n_docs")).first()[0] == len(messy_rows)
    assert length_histogram(count_tokens(no_documents, tokenizer_path)).collect() == []


def test_batches_of_texts_are_small(spark):
    from tabscope.llm.common import BATCH_ROWS, BATCH_SETTING, map_rows

    def sizes(batches):
        for batch in batches:
            yield {"n": [len(batch["id"])]}

    before = spark.conf.get(BATCH_SETTING)
    try:
        for given, most in ((10_000, BATCH_ROWS), (0, BATCH_ROWS), (300, 300)):
            spark.conf.set(BATCH_SETTING, given)
            found = [r["n"] for r in map_rows(spark.range(0, 9000, 1, 1), "n long", sizes).collect()]
            assert sum(found) == 9000 and max(found) == most
    finally:
        spark.conf.set(BATCH_SETTING, before)


def test_batches_of_long_texts_are_small(spark):
    import pyarrow as pa

    from tabscope.llm.common import map_rows

    def sizes(batches):
        for batch in batches:
            yield {"n": [len(batch["text"])], "size": [sum(map(len, batch["text"]))]}

    texts = spark.range(0, 600, 1, 1).selectExpr("repeat('x', 10000) AS text")
    for most in (2 << 20, 1 << 19):
        found = map_rows(texts, "n long, size long", sizes, most).collect()
        assert sum(r["n"] for r in found) == 600 and max(r["size"] for r in found) <= most

    def whole(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    plain = [r["n"] for r in texts.mapInArrow(whole, "n long").collect()]
    assert sum(plain) == 600 and max(plain) * 10_000 < 3e6


def test_tables_of_the_driver_pass_no_python_worker(spark):
    from tabscope.llm.common import listed

    for rows in ([("a", 1), (None, 2), ("b", None)], []):
        table = listed(spark, rows, "name string, n long")
        assert [tuple(r) for r in table.collect()] == rows
        assert table.schema == spark.createDataFrame(rows, "name string, n long").schema
        assert "ExistingRDD" not in table._jdf.queryExecution().toString()


def test_chunks_are_remembered_up_to_a_number(tokenizer_path):
    from tabscope.llm.tokens import ChunkEncoder

    few, many = ChunkEncoder(tokenizer_path, 1), ChunkEncoder(tokenizer_path)
    texts = [b"one two", b"two three, four", b"One TWO five"]
    assert [few.encode([text]) for text in texts] == [many.encode([text]) for text in texts]
    assert len(few.known) < len(many.known)
