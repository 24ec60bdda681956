"""Token ids by a public tokenizer with each distinct chunk encoded once; exact length histograms."""

from __future__ import annotations

import os
import re
import string
import struct
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tabscope.llm.common import by_value, map_rows, staged, texts_of

# Distinct chunks remembered by a task; beyond it the memory starts afresh, which changes no result.
REMEMBERED_CHUNKS = 600_000
REMEMBERED_LENGTH = 64
# Chunks encoded in one call, with a separator between them that no such chunk holds.
CALL_CHUNKS = 2_000
SEPARATOR = "\x01"
# The normaliser lowers case; doing so first for ASCII only makes fewer distinct chunks.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# Marks that may follow a word without changing its ids: all of ASCII but the apostrophe.
_MARKS = bytes(c for c in string.punctuation.encode() if c != ord("'"))
# Lower-case letters below this code point are left alone by normalisers and known to every version of Unicode.
PLAIN_LETTERS = 0x250


class ChunkEncoder:
    """Ids of whole texts under a tokenizer that lowers case, drops white space and never joins text across it.

    A text is cut at ASCII white space. The tokenizer's normaliser, splitter and merges all act inside such chunks, so
    the ids of the text are the ids of its chunks in order. Each distinct chunk is encoded once per task. A chunk of
    plain lower-case letters, with marks behind it or not, needs the merges alone: its letters are one word, and its marks another.
    Whether that holds is tried on each letter, with the whole tokenizer, when the encoder is made.
    """

    def __init__(self, path: str, remembered: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.remembered = REMEMBERED_CHUNKS if remembered is None else remembered
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # The library's own memory of words stays with the thread when the tokenizer is gone; chunks are remembered here.
        self.model._resize_cache(0)
        self.packed = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        self.separator = self._encode(SEPARATOR)
        self.known: dict[bytes, bytes] = {}
        self.marks: dict[bytes, bytes] = {}
        letters = [chr(i) for i in range(PLAIN_LETTERS) if chr(i).isalpha() and chr(i) == chr(i).lower()]
        spelled = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = {ord(c): spelled.pre_tokenize_str(c)[0][0] for c in letters}
        plain = [c for c in letters if self._word(f"a{c}{c}b") == self._encode(f"a{c}{c}b").tobytes()]
        self.plain = re.compile(f"[{''.join(plain)}]+") if plain else re.compile(r"(?!)")

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _word(self, word: str) -> bytes:
        return b"".join([self.packed[token.id] for token in self.model.tokenize(word.translate(self.spelling))])

    def _learn(self, chunks: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Each chunk with its ids."""
        others = []
        for chunk in chunks:
            head = chunk.rstrip(_MARKS)
            word = head.decode()
            if not self.plain.fullmatch(word):
                others.append(chunk)
            elif len(head) == len(chunk):
                yield chunk, self._word(word)
            else:
                marks = chunk[len(head) :]
                if marks not in self.marks:
                    self.marks[marks] = self._encode(marks.decode()).tobytes()
                yield chunk, self._word(word) + self.marks[marks]
        yield from self._learn_others(others)

    def _learn_others(self, chunks: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Many chunks in one call where the separator tells them apart."""
        apart = len(self.separator) == 1
        plain = [chunk for chunk in chunks if apart and b"\x01" not in chunk]
        for at in range(0, len(plain), CALL_CHUNKS):
            part = plain[at : at + CALL_CHUNKS]
            ids = self._encode(f" {SEPARATOR} ".join(chunk.decode() for chunk in part))
            cuts = np.flatnonzero(ids == self.separator[0])
            raw, starts = ids.tobytes(), [0, *(4 * (cuts + 1)).tolist()]
            ends = [*(4 * cuts).tolist(), len(raw)]
            yield from zip(part, [raw[a:b] for a, b in zip(starts, ends)])
        for chunk in chunks if not apart else [chunk for chunk in chunks if b"\x01" in chunk]:
            yield chunk, self._encode(chunk.decode()).tobytes()

    @staticmethod
    def _chunks(text: bytes) -> list[bytes]:
        # Special tokens are recognised before case is lowered.
        return (text if b"<|" in text else text.translate(_LOWER)).split()

    def encode(self, texts: Iterable[bytes | None]) -> list[list[bytes]]:
        """Per text the little-endian 32-bit ids of its chunks; a missing text has none."""
        if len(self.known) > self.remembered:
            self.known = {}
        if len(self.marks) > self.remembered:
            self.marks = {}
        split = [self._chunks(text or b"") for text in texts]
        table = self.known
        new = set().union(*split).difference(table)
        long = [chunk for chunk in new if len(chunk) > REMEMBERED_LENGTH]
        table.update(self._learn(list(new.difference(long))))
        table.update(self._learn(long))
        ids = [list(map(table.__getitem__, chunks)) for chunks in split]
        for chunk in long:
            del table[chunk]
        return ids


def count_tokens(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: its key and the number of tokens of its whole text.

    Missing and empty texts have 0; bytes that are no UTF-8 count as the replacement character; repeated rows are counted
    one by one, whatever their keys; an empty table gives no rows; other columns play no part.
    """

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        encoder = ChunkEncoder(tokenizer)
        for batch in batches:
            lengths = [sum(map(len, ids)) // 4 for ids in encoder.encode(batch["text"])]
            yield {"key": batch["key"], "n_tokens": lengths}

    kind = df.schema[key].dataType.simpleString()
    counted = map_rows(texts_of(df, key, text, valid=True), f"key {kind}, n_tokens long", task)
    return counted.withColumnRenamed("key", key)


def length_histogram(lengths: DataFrame, column: str = "n_tokens", block: int = 1024) -> DataFrame:
    """Every context limit that changes an answer, with exact totals, from one histogram of lengths.

    One row per distinct length L: documents of that length, documents and tokens up to it, documents beyond it, and
    the tokens that remain if every document is cut at L. The histogram is combined map-side, so any number of
    documents of one length is one row. Suffix sums run inside blocks of ``block`` lengths and join the running totals of the
    blocks, so no task holds all lengths. NULL lengths count as zero. An empty table gives no rows.
    """
    length = F.coalesce(F.col(f"`{column}`"), F.lit(0)).cast("long")
    histogram = staged(lengths.groupBy(length.alias("length")).agg(F.count("*").alias("n_docs")), "histogram")
    cells = histogram.withColumn("block", F.floor(F.col("length") / block)).withColumn(
        "tokens", F.col("length") * F.col("n_docs")
    )
    # A block of blocks keeps the running totals of the blocks out of one task as well.
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    totals = cells.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("block_tokens"))
    totals = totals.withColumn("group", F.floor(F.col("block") / block))
    later = Window.partitionBy("group").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    groups = totals.groupBy("group").agg(F.sum("docs").alias("g_docs"), F.sum("block_tokens").alias("g_tokens"))
    # At most (longest text / block^2) groups: a text of a billion tokens makes a thousand.
    beyond = {row["group"]: (row["g_docs"], row["g_tokens"]) for row in groups.collect()}
    order = sorted(beyond, reverse=True)
    docs_after = dict(zip(order, accumulate((beyond[g][0] for g in order), initial=0)))
    tokens_after = dict(zip(order, accumulate((beyond[g][1] for g in order), initial=0)))
    group_rows = [(g, docs_after[g], tokens_after[g]) for g in order]
    after = lengths.sparkSession.createDataFrame(group_rows, "group long, after_docs long, after_tokens long")
    blocks = totals.join(F.broadcast(after), "group").select(
        "block",
        (F.col("after_docs") + F.coalesce(F.sum("docs").over(later), F.lit(0))).alias("more_docs"),
        (F.col("after_tokens") + F.coalesce(F.sum("block_tokens").over(later), F.lit(0))).alias("more_tokens"),
    )
    all_docs, all_tokens = sum(d for d, _ in beyond.values()), sum(t for _, t in beyond.values())
    longer = F.col("more_docs") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))
    longer_tokens = F.col("more_tokens") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    return (
        cells.join(blocks, "block")
        .select("length", "n_docs", longer.alias("docs_longer"), longer_tokens.alias("tokens_longer"))
        .select(
            "length",
            "n_docs",
            (F.lit(all_docs) - F.col("docs_longer")).cast("long").alias("docs_within"),
            (F.lit(all_tokens) - F.col("tokens_longer")).cast("long").alias("tokens_within"),
            "docs_longer",
            (F.lit(all_tokens) - F.col("tokens_longer") + F.col("length") * F.col("docs_longer"))
            .cast("long")
            .alias("tokens_if_cut"),
            ((F.lit(all_docs) - F.col("docs_longer")) / F.lit(max(all_docs, 1))).alias("quantile"),
        )
    )


def length_quantile(histogram: DataFrame, share: float) -> DataFrame:
    """Smallest length that at least ``share`` of the documents do not exceed."""
    return histogram.where(F.col("quantile") >= share).agg(F.min("length").alias("length"))


by_value(__name__)
