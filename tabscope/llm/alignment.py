"""Alignment of two tokenizers: token-byte incidence matrices, their overlap products, and links by shared groups."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabscope.llm.common import _arrow_schema, _slices, by_value, staged, texts_of
from tabscope.operators.joins import lookup_join, measured_bytes

# Distinct chunks remembered by a task, and the longest of them; beyond it they are aligned again, with the same result.
REMEMBERED_CHUNKS, REMEMBERED_LENGTH = 300_000, 64
# Bytes of chunks aligned at a time; a single longer chunk is taken alone.
ALIGNED_BYTES = 1 << 20
# Products of one sweep of rows; a longer sweep is cut between rows.
SWEEP = 1 << 20
# Both vocabularies have fewer ids, so that a pair of ids is one number.
ID_BITS = 20
# Fixed value: how byte-level tokenizers of this kind split a text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# A space after which a chunk may not begin: no printable ASCII character or letter follows.
UNSAFE = re.compile(r" (?![!-~]|[^\W\d_])")


@dataclass
class Csr:
    """A sparse matrix by rows: row i has ``values`` in ``columns`` from starts[i] to starts[i + 1]."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @staticmethod
    def of(rows: np.ndarray, columns: np.ndarray, height: int, width: int, values: np.ndarray | None = None) -> Csr:
        """From entries in any order; entries of one cell are added up."""
        values = np.ones(len(rows), np.int64) if values is None else values
        cells = rows.astype(np.int64) * width + columns
        order = np.argsort(cells, kind="stable")
        cells, values = cells[order], values[order]
        first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, np.int64)
        own = cells[first] // width
        starts = np.searchsorted(own, np.arange(height + 1))
        return Csr(starts, cells[first] - own * width, np.add.reduceat(values, first) if len(first) else values, width)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def times(self, other: Csr) -> Csr:
        """The product by Gustavson's rows: row i is the sum of the rows of ``other`` that row i names, times its values.

        All rows of a sweep are expanded and added up together; sweeps of at most ``SWEEP`` products follow each other.
        """
        height = len(self.starts) - 1
        lengths = np.diff(other.starts)[self.columns]
        done = np.r_[0, np.cumsum(lengths)][self.starts]
        parts, at = [], 0
        while at < height:
            end = max(at + 1, int(np.searchsorted(done, done[at] + SWEEP, "right")) - 1)
            span = slice(self.starts[at], self.starts[end])
            n = lengths[span]
            rows = np.repeat(np.repeat(np.arange(at, end), np.diff(self.starts[at : end + 1])) - at, n)
            places = np.repeat(other.starts[self.columns[span]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            values = np.repeat(self.values[span], n) * other.values[places]
            parts.append(Csr.of(rows, other.columns[places], end - at, other.width, values))
            at = end
        if not parts:
            return Csr(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), other.width)
        sizes = np.concatenate([np.diff(part.starts) for part in parts])
        columns, values = (np.concatenate([getattr(part, name) for part in parts]) for name in ("columns", "values"))
        return Csr(np.r_[0, np.cumsum(sizes)], columns, values, other.width)


def token_bytes(ends: np.ndarray) -> Csr:
    """Incidence of tokens (rows) and bytes, of tokens that cover the bytes without gaps up to ``ends``."""
    n = int(ends[-1]) if len(ends) else 0
    return Csr(np.r_[0, ends].astype(np.int64), np.arange(n), np.ones(n, np.int64), n)


def byte_tokens(ends: np.ndarray) -> Csr:
    """The transposed incidence: bytes (rows) and tokens."""
    n = int(ends[-1]) if len(ends) else 0
    tokens = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
    return Csr(np.arange(n + 1), tokens, np.ones(n, np.int64), len(ends))


def shared_groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of every token of A and of B, from the overlap product of their incidences with the bytes.

    The overlaps, row by row, are a staircase: the next one shares its token of A or of B with the last one, unless both
    tokens end together. There a group ends.
    """
    if not len(ends_a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    overlaps = token_bytes(ends_a).times(byte_tokens(ends_b))
    rows, columns = overlaps.rows(), overlaps.columns
    group = np.r_[0, np.cumsum((rows[1:] != rows[:-1]) & (columns[1:] != columns[:-1]))]
    of_b = np.empty(len(ends_b), np.int64)
    of_b[columns] = group
    return group[overlaps.starts[:-1]], of_b


def _byte_alphabet() -> dict[str, int]:
    """Characters of byte-level vocabularies and their bytes: printable ones stand for themselves, the others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Both tokenizers with each distinct chunk encoded and aligned once.

    A text, with a space before it, is cut before each space that a printable character or letter follows and no space
    precedes. Tokenizer A splits words there, and no piece of B holds a space behind another character, which is tried
    when the aligner is made (else texts are not cut). So tokens of both end at every cut, and ids, groups and links of a
    text are those of its chunks in order.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = _byte_alphabet()
        vocabulary = {number: token for token, number in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [self._spelled(vocabulary.get(i, ""), alphabet) for i in range(max(vocabulary, default=-1) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(pieces)
        ]
        if max(len(self.bytes_a), len(self.bytes_b)) > 1 << ID_BITS:
            raise ValueError(f"vocabularies must have at most 2^{ID_BITS} ids")
        self.length_a, self.length_b = (np.array([len(x) for x in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        told = json.loads(self.a.to_str())
        kind = told["pre_tokenizer"] or {}
        self.cut = kind.get("type") == "ByteLevel" and kind.get("use_regex", False) and not kind.get("add_prefix_space")
        self.cut = self.cut and not any(re.search("[^▁]▁", piece) for piece in pieces)
        self.encode_a = self._faster(told, alphabet) or self._encode_a
        # How an id is written inside a group and at the end of its side, by code: ids of A, ids of B, and both again.
        self.names_a, self.names_b = ([b"%d" % i for i in range(len(own))] for own in (self.bytes_a, self.bytes_b))
        both = [*self.names_a, *self.names_b]
        last = [name + b"|" for name in self.names_a] + [name + b";" for name in self.names_b]
        self.spelled = [name + b"," for name in both] + last
        self.forget()

    @staticmethod
    def _spelled(token: str, alphabet: dict[str, int]) -> bytes:
        try:
            return bytes([alphabet[c] for c in token])
        except KeyError:  # an added token, which is never produced from plain text
            return token.encode()

    def _encode_a(self, texts: list[str]) -> list[list[int]]:
        return [one.ids for one in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _faster(self, told: dict, alphabet: dict[str, int]):
        """The same tokenizer by its ranks, if its merges are in the order of its ids and nothing else shapes its tokens."""
        model = told["model"]
        vocabulary, first = model["vocab"], 256
        plain = self.cut and told["normalizer"] is None and model["type"] == "BPE" and not model.get("ignore_merges")
        plain = plain and not any(model.get(name) for name in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        merges = [pair.split(" ") if isinstance(pair, str) else pair for pair in model.get("merges", ())]
        if not plain or any(vocabulary.get(a + b) != first + i for i, (a, b) in enumerate(merges)):
            return None
        if sorted(vocabulary[c] for c in alphabet if c in vocabulary) != list(range(first)):
            return None
        import tiktoken

        ranks = {self._spelled(token, alphabet): i for token, i in vocabulary.items() if i < first + len(merges)}
        by_rank = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [by_rank.encode_ordinary(text) for text in texts]

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.facts = np.zeros((0, 5), np.int64)
        self.pairs = Csr(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 1 << (2 * ID_BITS))

    def chunks(self, text: str) -> list[str]:
        """The chunks of the text with a space before it, each without the space that it begins with."""
        if not self.cut:
            return [text]
        parts = text.split(" ")
        if not UNSAFE.search(" " + text):
            return parts
        merged = [parts[0]]
        for before, part in zip(parts, parts[1:]):
            if before and part and not UNSAFE.match(" " + part):
                merged.append(part)
            else:
                merged[-1] += " " + part
        return merged

    def learn(self, chunks: list[str]) -> None:
        """Encode and align new chunks; facts: whether the bytes are restored, tokens of A, of B, groups, links."""
        ends = np.cumsum([4 * len(chunk) + 4 for chunk in chunks])
        at = 0
        while at < len(chunks):
            room = (ends[at - 1] if at else 0) + 4 * ALIGNED_BYTES
            end = max(at + 1, int(np.searchsorted(ends, room, "right")))
            self._learn(chunks[at:end])
            at = end

    def _flat_a(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A of all chunks, and their number by chunk.

        Chunks that begin a text as any other follow each other in one text, which is cut between them by itself.
        """
        joined = [i for i, chunk in enumerate(chunks) if self.cut and not chunk.endswith(" ") and not UNSAFE.match(" " + chunk)]
        alone = sorted(set(range(len(chunks))).difference(joined))
        ids = [self.encode_a([" " + chunks[i]])[0] for i in alone]
        sizes = np.zeros(len(chunks), np.int64)
        sizes[alone] = [len(own) for own in ids]
        if not joined:
            return np.fromiter(chain.from_iterable(ids), np.int64), sizes
        flat = np.array(self.encode_a(["".join([" " + chunks[i] for i in joined])])[0], np.int64)
        ends = np.cumsum([len(chunks[i].encode()) + 1 for i in joined])
        cuts = np.searchsorted(np.cumsum(self.length_a[flat]), ends) + 1
        sizes[joined] = np.diff(np.r_[0, cuts])
        if not alone:
            return flat, sizes
        pieces = dict(zip(joined, np.split(flat, cuts[:-1]))) | dict(zip(alone, (np.array(own, np.int64) for own in ids)))
        return np.concatenate([pieces[i] for i in range(len(chunks))]), sizes

    def _learn(self, chunks: list[str]) -> None:
        flat_a, sizes_a = self._flat_a(chunks)
        ids_b = self.b.encode(chunks, num_threads=1)
        sizes_b = np.fromiter(map(len, ids_b), np.int64, len(chunks))
        flat_b = np.fromiter(chain.from_iterable(ids_b), np.int64, int(sizes_b.sum()))
        raw = [b" " + chunk.encode() for chunk in chunks]
        whole = np.ones(len(chunks), np.int64)
        for flat, sizes, own, lengths in ((flat_a, sizes_a, self.bytes_a, self.length_a), (flat_b, sizes_b, self.bytes_b, self.length_b)):
            spelled = b"".join(map(own.__getitem__, flat.tolist()))
            at = np.r_[0, np.cumsum(lengths[flat])][np.r_[0, np.cumsum(sizes)]]
            if (np.diff(at) != np.fromiter(map(len, raw), np.int64, len(raw))).any() or spelled != b"".join(raw):
                bounds = at.tolist()
                whole &= np.array([spelled[low:high] == one for one, low, high in zip(raw, bounds, bounds[1:])], np.int64)
        if not whole.all():
            flat_a, flat_b = (flat[np.repeat(whole, sizes) == 1] for flat, sizes in ((flat_a, sizes_a), (flat_b, sizes_b)))
            sizes_a, sizes_b = sizes_a * whole, sizes_b * whole
        of_a, of_b = shared_groups(np.cumsum(self.length_a[flat_a]), np.cumsum(self.length_b[flat_b]))
        n, n_groups = len(chunks), int(of_a[-1]) + 1 if len(of_a) else 0
        chunk_a = np.repeat(np.arange(n), sizes_a)
        in_a, in_b = np.bincount(of_a, minlength=n_groups), np.bincount(of_b, minlength=n_groups)
        chunk_of = np.zeros(n_groups, np.int64)
        chunk_of[of_a] = chunk_a
        groups = np.bincount(chunk_of, minlength=n)
        links = np.zeros(n, np.int64)
        np.add.at(links, chunk_of, in_a * in_b)
        facts = np.stack([whole, sizes_a, sizes_b, groups, links], 1)
        self.groups += self._spell(flat_a, flat_b, of_a, of_b, chunk_of, n)

        # Rows: an id of A in one chunk. Its groups, times the ids of B in each group, are its links.
        rows, row_of = np.unique(chunk_a << ID_BITS | flat_a, return_inverse=True)
        id_groups = Csr.of(row_of, of_a, len(rows), max(n_groups, 1))
        linked = id_groups.times(Csr.of(of_b, flat_b, max(n_groups, 1), 1 << ID_BITS))
        entry = rows[linked.rows()]
        pair = (entry & ((1 << ID_BITS) - 1)) << ID_BITS | linked.columns
        starts = np.searchsorted(entry >> ID_BITS, np.arange(n + 1))
        self.pairs = Csr(
            np.r_[self.pairs.starts, starts[1:] + self.pairs.starts[-1]],
            np.r_[self.pairs.columns, pair],
            np.r_[self.pairs.values, linked.values],
            self.pairs.width,
        )
        first = len(self.groups) - n
        self.known.update((chunk, first + i) for i, chunk in enumerate(chunks))
        self.facts = np.concatenate([self.facts, facts])

    def _spell(self, flat_a, flat_b, of_a, of_b, chunk_of, n) -> list[bytes]:
        """Per chunk its groups in order: ids of A, a bar, ids of B, a semicolon."""
        side = np.r_[of_a * 2, of_b * 2 + 1]
        order = np.argsort(side, kind="stable")
        side = side[order]
        ends = np.r_[side[1:] != side[:-1], True] if len(side) else np.zeros(0, bool)
        ids = np.r_[flat_a, flat_b][order]
        codes = (side & 1) * len(self.names_a) + ids + np.where(ends, len(self.names_a) + len(self.names_b), 0)
        words = list(map(self.spelled.__getitem__, codes.tolist()))
        chunk = chunk_of[side >> 1] if len(side) else side
        cuts = np.searchsorted(chunk, np.arange(n + 1)).tolist()
        return [b"".join(words[a:b]) for a, b in zip(cuts, cuts[1:])]

    def align(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[str], Csr]:
        """Per text its n_a, n_b, n_groups, n_links; the digest of its groups; and its linked pairs of ids."""
        if len(self.known) > REMEMBERED_CHUNKS:
            self.forget()
        split = [self.chunks(text) if text else [] for text in map(_decoded, texts)]
        new = set().union(*split).difference(self.known)
        long = sorted(chunk for chunk in new if len(chunk) > REMEMBERED_LENGTH)
        if short := sorted(chunk for chunk in new if len(chunk) <= REMEMBERED_LENGTH):
            self.learn(short)
        remembered = len(self.groups), self.facts, self.pairs
        self.learn(long)
        sizes = [len(chunks) for chunks in split]
        places = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, sum(sizes))
        text_of = np.repeat(np.arange(len(texts)), sizes)
        valid = np.ones(len(texts), bool)
        valid[text_of[self.facts[places, 0] == 0]] = False
        kept = valid[text_of]
        facts = np.zeros((len(texts), 4), np.int64)
        np.add.at(facts, text_of[kept], self.facts[places[kept], 1:])
        digests, at = [], 0
        for i, size in enumerate(sizes):
            own = places[at : at + size].tolist()
            at += size
            joined = b"".join([self.groups[p] for p in own]) if valid[i] and size else b""
            digests.append(hashlib.sha256(joined[:-1]).hexdigest() if joined else "")
        held = Csr.of(text_of[kept], places[kept], len(texts), max(len(self.groups), 1))
        pairs = held.times(self.pairs)
        for chunk in long:
            del self.known[chunk]
        self.groups, self.facts, self.pairs = self.groups[: remembered[0]], *remembered[1:]
        return facts, digests, pairs


def _decoded(text: bytes | None) -> str | None:
    try:
        return None if text is None else text.decode()
    except UnicodeDecodeError:  # no tokens of text restore such bytes
        return None


def linked_pairs(df: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``df``: row, key, n_a, n_b, n_groups, n_links, groups_sha256, and its linked pairs with their links."""
    kind = df.schema[key].dataType.simpleString()
    schema = StructType.fromDDL(
        f"key {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "pairs array<struct<pair: long, links: long>>"
    )
    arrow = _arrow_schema(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        for batch in batches:
            for part in _slices(batch):
                facts, digests, pairs = aligner.align(part.column(1).to_pylist())
                linked = pa.StructArray.from_arrays([pa.array(pairs.columns), pa.array(pairs.values)], names=["pair", "links"])
                lists = pa.ListArray.from_arrays(pa.array(pairs.starts, pa.int32()), linked).cast(arrow.field("pairs").type)
                numbers = [pa.array(facts[:, i]) for i in range(4)]
                yield pa.RecordBatch.from_arrays([part.column(0), *numbers, pa.array(digests, pa.string()), lists], schema=arrow)

    found = texts_of(df, key, text).mapInArrow(run, schema)
    return found.withColumn("row", F.monotonically_increasing_id())


def align_tokenizers(df: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``df``: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A (byte-level BPE) encodes a space and the text, B (pieces with byte fallback) the text, to which it adds the space.
    Groups lie between the byte offsets where tokens of both end; all token pairs of a group are linked. A pair of ids
    counts the rows that hold it linked. n_best are the links whose count is the highest of their id of A, ties
    included; count_sum adds up the counts of all links. NULL and empty texts, texts that either side does not restore
    byte by byte, and invalid UTF-8 have no tokens: zeros and ''. Repeated rows count one by one, whatever their keys; an
    empty table gives no rows; other columns play no part.

    The pairs of each row are written once, without its text. Counts are combined map-side; one id of A has at most as
    many pairs as B has ids. Counts go to every task within 64 MB, else rows of hot pairs are spread over pieces.
    """
    rows = staged(linked_pairs(df, path_a, path_b, key, text), "linked-pairs")
    single = rows.select("row", F.explode("pairs").alias("x")).select("row", F.col("x.pair").alias("pair"), F.col("x.links").alias("links"))
    counts = staged(single.groupBy("pair").agg(F.count("*").alias("n_rows")), "pair-counts")
    of_a = Window.partitionBy(F.shiftright("pair", ID_BITS))
    counts = staged(counts.withColumn("best", F.col("n_rows") == F.max("n_rows").over(of_a)), "pair-counts")
    found = lookup_join(single, counts, ["pair"], measured_bytes(counts), spread_by=["row"])
    sums = found.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"),
        F.sum(F.col("links") * F.col("n_rows")).alias("count_sum"),
    )
    return rows.drop("pairs").join(sums, "row", "left").select(
        F.col("key").alias(key),
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"),
        "groups_sha256",
    )


by_value(__name__)
