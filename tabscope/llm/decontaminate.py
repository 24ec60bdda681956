"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of passage and item."""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import by_value, map_rows, texts_of

SEED_WORDS = 3
# A seed is rare if its words, were they independent, would meet in so few documents of a thousand words.
RARE = 1e-3
# Share of the score of an unchanged copy that a passage must reach.
LEAST_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
# Items whose words and seeds a task holds at once; more items are taken in blocks.
BLOCK_ITEMS = 20_000
# An alignment of so many words or more is reported by its own score, whatever share of the item it is.
LEAST_WORDS = 13
# Letters and digits of ASCII stay, the rest of it becomes a space; bytes of other characters stay.
_WORDS = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))
# A text with more distinct characters beyond ASCII is translated in one pass instead of one by one.
MANY_CHARACTERS = 40
# Ranges of scripts written without spaces, whose characters are words (Thai and Lao, Myanmar, Khmer, Tai,
# kana, Han, Javanese).
SPACELESS = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x3005, 0x3007),
    (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA980, 0xA9DF), (0xAA60, 0xAADF),
    (0xF900, 0xFAFF), (0xFF66, 0xFF9D), (0x20000, 0x3FFFF),
)


class _Characters(dict):
    """What each code point becomes: letters, marks and digits stay, alone in scripts without spaces; the rest splits."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        if unicodedata.category(char)[0] not in "LMN":
            value = " "
        else:
            value = f" {char} " if any(low <= code <= high for low, high in SPACELESS) else char
        self[code] = value
        return value


_CHARACTERS = _Characters({code: chr(code) for code in range(128)})


def normal_words(text: bytes | None) -> list[bytes]:
    """Lower-case words in UTF-8, split at all that is no letter, mark or digit of Unicode."""
    lower = (text or b"").decode("utf-8", "replace").lower()
    if not lower.isascii():
        others = [char for char in set(lower) if char > "\x7f"]
        if len(others) > MANY_CHARACTERS:
            lower = lower.translate(_CHARACTERS)
        else:
            for char in others:
                if (value := _CHARACTERS[ord(char)]) != char:
                    lower = lower.replace(char, value)
    return lower.encode().translate(_WORDS).split()


class Vocabulary(dict):
    """Place of each word of the benchmark; any other word is -1."""

    def __missing__(self, word: bytes) -> int:
        return -1

    def places(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


@dataclass
class Block:
    """Items as arrays of word places, and their n-grams as sorted codes."""

    ids: list
    vocabulary: dict
    items: list[np.ndarray]

    def codes(self, places: np.ndarray, size: int = SEED_WORDS) -> np.ndarray:
        """Code of the n-gram at each place; -1 where a word is not of the benchmark."""
        if len(places) < size:
            return np.zeros(0, np.int64)
        n = len(places) - size + 1
        total, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(size):
            part = places[k : k + n]
            total = total * len(self.vocabulary) + part
            known &= part >= 0
        return np.where(known, total, -1)


def _block(rows: list[tuple]) -> Block:
    vocabulary: dict[bytes, int] = {}
    items = []
    for _, text in rows:
        items.append(np.array([vocabulary.setdefault(word, len(vocabulary)) for word in normal_words(text)], np.int64))
    return Block([key for key, _ in rows], vocabulary, items)


def _word_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """Occurrences of each word of the vocabulary in all documents, and of all words."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        known = Vocabulary(shared.value)
        counts = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            for text in batch["text"]:
                words = normal_words(text)
                if words:
                    counts += np.bincount(known.places(words) + 1, minlength=len(counts))
        word = counts.nonzero()[0]
        yield {"word": word, "n": counts[word]}

    found = map_rows(docs.select("text"), "word long, n long", task).groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(vocabulary) + 1, np.int64)
    for row in found:
        counts[row["word"]] = row["n"]
    return counts[1:], int(counts.sum())


def rare_seeds(block: Block, counts: np.ndarray, total: int, rare: float = RARE) -> dict[int, dict[int, list]]:
    """By the number of words of a seed: code of each seed with the (item, place) pairs that hold it.

    Rarity is judged by the words' counts over the whole corpus: how often they would meet by chance in a thousand
    words. Copies of an item, however many, do not make its seeds common. Each stretch of ``LEAST_WORDS`` words keeps
    its rarest n-gram, rare or not, so that a copy of any such part holds a seed; so does an item shorter than that. An
    item shorter than a seed is one as a whole.
    """
    share = np.maximum(counts, 1) / max(total, 1)
    seeds: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
    for i, places in enumerate(block.items):
        size = min(SEED_WORDS, len(places))
        if not size:
            continue
        codes = block.codes(places, size)
        chance = np.ones(len(codes))
        for k in range(size):
            chance *= share[places[k : k + len(codes)]]
        stretches = np.lib.stride_tricks.sliding_window_view(chance, min(LEAST_WORDS - SEED_WORDS + 1, len(chance)))
        kept = np.union1d(np.arange(len(stretches)) + stretches.argmin(1), np.flatnonzero(1000 * chance <= rare))
        for at in kept.tolist():
            seeds[size][int(codes[at])].append((i, at))
    return {size: dict(own) for size, own in seeds.items()}


def align(item: np.ndarray, passage: np.ndarray, per_word: int = 0) -> tuple[int, int, int]:
    """Best local alignment by Smith-Waterman with linear gaps: (score, first, end) of the passage's words.

    Every aligned word of the passage costs ``per_word`` of its score. A cell holds its score and, below it, the place
    where its alignment begins (the earlier wins a tie), as one number, so that a row is a few vector operations; gaps
    along the row are a running maximum.
    """
    if not len(passage):
        return 0, 0, 0
    width = 1 << 32
    places = np.arange(len(passage), dtype=np.int64)
    fresh = width - 1 - places
    fall = (GAP - per_word) * width * places
    above = np.concatenate([[width - 1], fresh])  # cell before the first word, then one per word
    best = (0, 0, 0)
    for word in item.tolist():
        step = (np.where(passage == word, MATCH, MISMATCH) - per_word) * width
        diagonal = np.where(above[:-1] >= width, above[:-1], fresh) + step
        cell = np.maximum(np.maximum(diagonal, above[1:] + GAP * width), fresh)
        cell = np.maximum.accumulate(cell - fall) + fall
        cell = np.maximum(cell, fresh)
        top = int(cell.argmax())
        score = int(cell[top] // width)
        if score > best[0]:
            best = (score, width - 1 - int(cell[top] % width), top + 1)
        above = np.concatenate([[width - 1], cell])
    return best


def passage_of(item: np.ndarray, passage: np.ndarray, least: float) -> tuple[int, int, int] | None:
    """(score, first, end) of a passage that reaches ``least`` of a copy of the item, or of ``LEAST_WORDS`` of its words.

    The best alignment may reach across words between two copied parts, so that it falls below the share of its own
    length; then the best one that gains by every word more than half of a match is taken. Words that the item does not
    hold add nothing, so too few others rule a passage out.
    """
    if MATCH * np.isin(passage, item).sum() < least * MATCH * min(len(item), LEAST_WORDS):
        return None
    score, first, end = align(item, passage)
    if score >= least * MATCH * len(item):
        return score, first, end
    if score < least * MATCH * LEAST_WORDS:
        return None
    if end - first >= LEAST_WORDS and score >= least * MATCH * (end - first):
        return score, first, end
    gain, first, end = align(item, passage, per_word=MATCH // 2)
    score = gain + MATCH // 2 * (end - first)
    return (score, first, end) if end - first >= LEAST_WORDS and score >= least * MATCH * (end - first) else None


def find_items(places: np.ndarray, block: Block, seeds: list[tuple], least: float) -> list[tuple]:
    """(item, score share, first, end) of the best passage of each item that ``passage_of`` accepts."""
    hits: dict[int, list[int]] = defaultdict(list)
    for size, codes, holders in seeds:
        own = block.codes(places, size)
        at = np.searchsorted(codes, own)
        at[at == len(codes)] = 0
        for where in np.flatnonzero(codes[at] == own).tolist():
            for item, place in holders[at[where]]:
                hits[item].append(where - place)
    found = []
    for item, begins in hits.items():
        words = block.items[item]
        slack = len(words) // 2 + 2
        best, stop = (0, 0, 0), -1
        begins.sort()
        for i, begin in enumerate(begins):
            low, high = begin - slack, begin + len(words) + slack
            if i == 0 or low > stop:
                start = max(low, 0)
            stop = high
            if i + 1 < len(begins) and begins[i + 1] - slack <= stop:
                continue  # the next window overlaps: take both as one
            if passage := passage_of(words, places[start : max(stop, 0)], least):
                best = max(best, (passage[0], -(start + passage[1]), start + passage[2]))
        if best[0]:
            found.append((item, best[0] / (MATCH * len(words)), -best[1], best[2]))
    return found


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    least_score: float = LEAST_SCORE,
    rare: float = RARE,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """One row per document row and item it holds: both keys, score (1 for an unchanged copy), first and end word.

    An item is held by a passage of at least ``least_score`` of its score, or of ``LEAST_WORDS`` or more of its words at
    that share of their own score; the score is always the share of the whole item.
    Items are the query set: they come in blocks of about ``block_items``, so a task never holds more, and every block
    meets all documents. One pass counts the items' words over the whole corpus, a second finds the rare seeds and aligns
    around them; nothing is shuffled but the counts. Texts are compared whole, as lower-case words. Missing or empty texts, of documents or items, hold and give nothing;
    repeated rows are reported one by one; an empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    texts = texts_of(docs, key, text)
    kinds = docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
    schema = f"key {kinds[0]}, item {kinds[1]}, score double, first_word long, end_word long"
    given = texts_of(benchmark, item_key, item_text).where(F.length("text") > 0)
    blocks = -(-given.count() // block_items)
    results = []
    for number in range(blocks):
        own = given.where(F.pmod(F.xxhash64("key", "text"), F.lit(blocks)) == number)
        block = _block([(row["key"], bytes(row["text"])) for row in own.collect()])
        seeds = rare_seeds(block, *_word_counts(texts, block.vocabulary), rare)
        listed = [(size, np.array(sorted(own), np.int64), [own[code] for code in sorted(own)]) for size, own in seeds.items()]
        shared = spark.sparkContext.broadcast((block.ids, block.vocabulary, block.items, listed))

        def task(batches: Iterator[dict], shared=shared) -> Iterator[dict]:
            ids, vocabulary, items, listed = shared.value
            block, known = Block(ids, vocabulary, items), Vocabulary(vocabulary)
            for batch in batches:
                out: dict[str, list] = {"key": [], "item": [], "score": [], "first_word": [], "end_word": []}
                for key, text in zip(batch["key"], batch["text"]):
                    for item, *rest in find_items(known.places(normal_words(text)), block, listed, least_score):
                        for name, value in zip(out, (key, ids[item], *rest)):
                            out[name].append(value)
                yield out

        results.append(map_rows(texts, schema, task))
    if not results:
        return spark.createDataFrame([], schema).withColumnsRenamed({"key": key, "item": item_key})
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    return found.withColumnsRenamed({"key": key, "item": item_key})


by_value(__name__)
