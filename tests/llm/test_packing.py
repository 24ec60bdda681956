import itertools
import struct
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabscope.llm.packing import fill_window, pack, plan_windows, token_pieces
from tabscope.llm.queries import packed


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), max_size=5), st.integers(0, 30))
def test_fullest_window(counts, room):
    used = fill_window(counts, room)
    total = sum(length * n for length, n in used.items())
    every = itertools.product(*[range(n + 1) for n in counts.values()])
    sums = (sum(a * b for a, b in zip(counts, pick)) for pick in every)
    assert total == max(s for s in sums if s <= room)
    assert all(0 < n <= counts[length] for length, n in used.items())


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 10_000), max_size=20))
def test_plan_places_every_piece(histogram):
    placed = defaultdict(int)
    for windows, pattern in plan_windows(histogram, 64):
        assert windows > 0 and sum(length * n for length, n in pattern.items()) <= 64
        for length, n in pattern.items():
            placed[length] += windows * n
    assert dict(placed) == histogram


def check(rows, capacity):
    windows = defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return windows


def test_contract(messy, messy_rows, tokenizer_path):
    rows = packed(messy).collect()
    check(rows, 2048)
    tokenizer = Tokenizer.from_file(tokenizer_path)
    want = sorted(
        (str(doc), start, len(ids[start : start + 2048]), zlib.crc32(struct.pack(f"<{len(ids[start : start + 2048])}I", *ids[start : start + 2048])), len(ids))
        for doc, text, *_ in messy_rows
        for ids in [tokenizer.encode(text or "", add_special_tokens=False).ids + [1]]
        for start in range(0, len(ids), 2048)
    )
    assert sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want


def test_little_padding_and_kept_columns(spark, tokenizer_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = token_pieces(docs, tokenizer_path, 2048)
    rows = pack(pieces, 2048).collect()
    windows = check(rows, 2048)
    tokens = sum(r["length"] for r in rows)
    assert 2048 * len(windows) - tokens < 2 * 2048
    assert all(len(r["ids"]) == 4 * r["length"] for r in rows)


def test_hot_length_empty_and_unfit(spark, no_documents):
    same = spark.range(5000).select("id", F.lit(700).cast("long").alias("length"))
    windows = check(pack(same, 2048).collect(), 2048)
    assert len(windows) == 2500
    assert packed(no_documents).collect() == []
    with pytest.raises(Exception, match="1 to 2048"):
        pack(same.withColumn("length", F.lit(2049).cast("long")), 2048).collect()


def test_columns_of_any_name_are_kept(spark):
    names = ["place", "first", "before", "low", "high", "per_window", "s_length", "n", "piece", "rank"]
    pieces = spark.createDataFrame([(i, 1 + i % 7) for i in range(60)], "doc_id long, length long")
    named = pieces.withColumns({name: F.col("doc_id") * (at + 2) for at, name in enumerate(names)})
    rows = pack(named, 16).collect()
    assert len(rows) == 60
    assert all(r[name] == r["doc_id"] * (at + 2) for r in rows for at, name in enumerate(names))
