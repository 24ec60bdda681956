"""Language spans: script ranges narrow the candidates, Viterbi over per-word scores with a switching penalty."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import WORD_BATCH_BYTES, by_value, map_rows, texts_of

WORD = re.compile(r"[^\W\d_]+")
# First code point of each range and its script; letters of other ranges count as "other".
SCRIPT_STARTS = (
    (0x0000, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
)
STARTS = np.array([start for start, _ in SCRIPT_STARTS])
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})
SCRIPT_PLACES = np.array([SCRIPTS.index(name) for _, name in SCRIPT_STARTS])
# Cells of n-gram counts per language: the bound of the model, whatever the corpus.
CELLS = 1 << 16
LONGEST_GRAM = 4
# Languages of a model at most: those with most labelled rows.
MOST_LANGUAGES = 256
SWITCH_PENALTY = 12.0
LEAST_SCRIPT_SHARE = 0.01
OUTSIDE_SCRIPT = -20.0
REMEMBERED_WORDS = 100_000
# Words whose n-grams are laid out at once: a word has some 40, of 8 bytes in each of several arrays.
WORDS_AT_ONCE = 4096
# Fixed value: multiplier of the n-gram hash.
_STEP = np.uint64(0x9E3779B97F4A7C15)
UNDETERMINED = "und"
# Share of the words learned from that may lie below the level of their language.
BELOW_LEVEL = 0.02
# Bins of mean log probabilities, per unit and in all (the last one for what is lower still: nothing is with
# fewer than 10 ** 20 n-grams).
BINS_PER_UNIT, BINS = 64, 64 * 48


def word_blocks(words: Iterable[str]) -> Iterator[list[str]]:
    """The words in order, in lists of ``WORDS_AT_ONCE``: what is computed of each word alone takes bounded memory."""
    rest = iter(words)
    while block := list(islice(rest, WORDS_AT_ONCE)):
        yield block


def gram_cells(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the word, cell) of every n-gram of the lower-cased words, with their ends marked."""
    marked = [f" {word.lower()} " for word in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), lengths)
    total = np.zeros(len(codes), np.uint64)
    places, cells = [], []
    for n in range(1, LONGEST_GRAM + 1):
        size = len(codes) - n + 1
        if size <= 0:
            break
        total = (total[:size] + codes[n - 1 :] + np.uint64(n)) * _STEP
        total ^= total >> np.uint64(31)
        inside = owner[:size] == owner[n - 1 :]
        places.append(owner[:size][inside])
        cells.append((total[inside] >> np.uint64(20)) % np.uint64(CELLS))
    return np.concatenate(places), np.concatenate(cells).astype(np.int64)


def scripts_of(words: list[str]) -> np.ndarray:
    """Place in ``SCRIPTS`` of each word's first letter."""
    first = np.fromiter((ord(word[0]) for word in words), np.int64, len(words))
    return SCRIPT_PLACES[np.searchsorted(STARTS, first, side="right") - 1]


@dataclass
class LanguageModel:
    """Languages, log probabilities (language by cell), the languages that each script allows, and sums of counts."""

    languages: list[str]
    log_probs: np.ndarray
    allowed: np.ndarray
    totals: np.ndarray | None = None


def _labelled(df: DataFrame, text: str, lang: str) -> DataFrame:
    """Label and text of all rows that have both."""
    value, name = F.col(f"`{text}`"), F.col(f"`{lang}`")
    return df.where(value.isNotNull() & name.isNotNull()).select(name.alias("lang"), F.make_valid_utf8(value).alias("text"))


def _word_counts(batches: Iterator[dict]) -> Iterator[tuple[str, Counter]]:
    """Languages and counts of their words, over all texts; they are given, and forgotten, at ``REMEMBERED_WORDS`` words."""
    words: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        for name, value in zip(batch["lang"], batch["text"]):
            words[name].update(WORD.findall(value))
        if sum(map(len, words.values())) > REMEMBERED_WORDS:
            yield from words.items()
            words.clear()
    yield from words.items()


def train_language_model(df: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Counts of n-grams and scripts per language over all labelled rows.

    Counts are summed inside tasks, then by (language, cell); the driver receives at most ``CELLS`` + scripts numbers a
    language. The ``MOST_LANGUAGES`` labels of most rows are learned, so that a model has a bounded size; rows of other
    labels, without text or without label are left out. Without any labelled row every text is undetermined.
    """
    labelled = _labelled(df, text, lang)
    counted = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    languages = sorted(row["lang"] for row in counted.collect())
    if not languages:
        return LanguageModel([], np.zeros((0, CELLS)), np.zeros((0, len(SCRIPTS)), bool))
    place = {name: i for i, name in enumerate(languages)}

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        counts = np.zeros((len(languages), CELLS + len(SCRIPTS)), np.int64)
        for name, found in _word_counts(batches):
            row = counts[place[name]]
            for block in word_blocks(found):
                times = np.fromiter(map(found.__getitem__, block), np.int64, len(block))
                owner, cells = gram_cells(block)
                row[:CELLS] += np.bincount(cells, times[owner], CELLS).astype(np.int64)
                row[CELLS:] += np.bincount(scripts_of(block), times, len(SCRIPTS)).astype(np.int64)
        language, cell = counts.nonzero()
        yield {"language": language, "cell": cell, "n": counts[language, cell]}

    rows = labelled.where(F.col("lang").isin(languages))
    found = map_rows(rows, "language int, cell int, n long", task, WORD_BATCH_BYTES)
    counts = np.zeros((len(languages), CELLS + len(SCRIPTS)))
    for row in found.groupBy("language", "cell").agg(F.sum("n").alias("n")).collect():
        counts[row["language"], row["cell"]] = row["n"]
    grams, scripts = counts[:, :CELLS] + 0.5, counts[:, CELLS:]
    allowed = scripts >= LEAST_SCRIPT_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)
    totals = grams.sum(1, keepdims=True)
    return LanguageModel(languages, np.log(grams / totals), allowed, totals)


def gram_sums(words: list[str], model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the log probabilities of each word's n-grams (word by language), how many it has, the languages its script allows."""
    owner, cells = gram_cells(words)
    sums = np.stack([np.bincount(owner, probs[cells], len(words)) for probs in model.log_probs], 1)
    return sums, np.bincount(owner, minlength=len(words)), model.allowed[:, scripts_of(words)].T


def means_without(words: list[str], seen: np.ndarray) -> np.ndarray:
    """Mean log probability of each word's n-grams by one language's counts per cell, less one occurrence of that word."""
    owner, cells = gram_cells(words)
    grams = np.bincount(owner, minlength=len(words))
    pairs, own = np.unique(owner * CELLS + cells, return_counts=True)
    left, rest = np.maximum(seen[pairs % CELLS] - own, 0.0), np.maximum(seen.sum() - grams, 0.0)
    return np.bincount(pairs // CELLS, own * np.log(left + 0.5), len(words)) / grams - np.log(rest + 0.5 * CELLS)


def explained_levels(
    df: DataFrame, model: LanguageModel, text: str = "text", lang: str = "lang", below: float = BELOW_LEVEL
) -> np.ndarray:
    """Per language the mean log probability that all but a share ``below`` of the words that it was learned from reach.

    ``df`` is that of the model; all its labelled rows count. Each word with a letter is scored without one occurrence of
    itself, so that the level is that of words not seen in training. Tasks count words per bin; the driver receives
    ``BINS`` numbers a language. A language without words has no level that a word could reach.
    """
    levels = np.full(len(model.languages), np.inf)
    if not model.languages:
        return levels
    place = {name: i for i, name in enumerate(model.languages)}
    seen = np.rint(np.exp(model.log_probs) * model.totals - 0.5)
    shared = df.sparkSession.sparkContext.broadcast((seen, model.allowed))

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        seen, allowed = shared.value
        found = np.zeros((len(place), BINS), np.int64)
        for name, own in _word_counts(batches):
            at = place[name]
            for block in word_blocks(word for word in own if any(map(str.isalpha, word))):
                means = np.where(allowed[at, scripts_of(block)], means_without(block, seen[at]), -np.inf)
                bins = np.minimum(-means * BINS_PER_UNIT, BINS - 1).astype(np.int64)
                times = np.fromiter(map(own.__getitem__, block), np.int64, len(block))
                found[at] += np.bincount(bins, times, BINS).astype(np.int64)
        language, at = found.nonzero()
        yield {"language": language, "bin": at, "n": found[language, at]}

    rows = _labelled(df, text, lang).where(F.col("lang").isin(model.languages))
    found = map_rows(rows, "language int, bin int, n long", task, WORD_BATCH_BYTES)
    bins = np.zeros((len(levels), BINS), np.int64)
    for row in found.groupBy("language", "bin").agg(F.sum("n").alias("n")).collect():
        bins[row["language"], row["bin"]] = row["n"]
    for i, own in enumerate(bins):
        if own.any():
            last = int(np.searchsorted(np.cumsum(own), (1 - below) * own.sum()))
            levels[i] = -(last + 1) / BINS_PER_UNIT
    return levels


def explained_shares(
    df: DataFrame, model: LanguageModel, levels: np.ndarray, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row: key and explained, the share of its words that reach the level of the language identified for them.

    See ``identify_languages``, whose spans say which language that is.
    """
    return identify_languages(df, model, key, text, levels=levels).select(F.col(f"`{key}`"), "explained")


class WordScorer:
    """Score of each distinct word under each language; the languages that its script rules out are far below.

    With ``levels`` also whether the word reaches the level of each language.
    """

    def __init__(self, model: LanguageModel, levels: np.ndarray | None = None):
        self.model, self.levels, self.known = model, levels, {}
        self.rows = np.zeros((0, len(model.languages)))
        self.reached = np.zeros((0, len(model.languages)), bool)

    def learn(self, texts: list[list[str]]) -> None:
        """Score the words of these texts that are not known yet, a block of them at once."""
        if len(self.known) > REMEMBERED_WORDS:
            self.known, self.rows, self.reached = {}, self.rows[:0], self.reached[:0]
        new = set().union(*texts).difference(self.known)
        if not new or not self.model.languages:
            return
        rows, reached = [self.rows], [self.reached]
        for block in word_blocks(new):
            self.known.update(zip(block, range(len(self.known), len(self.known) + len(block))))
            scores, reaches = self._scored(block)
            rows.append(scores)
            reached.append(reaches)
        self.rows, self.reached = np.concatenate(rows), np.concatenate(reached)

    def _scored(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the words, and whether they reach the levels; without levels no rows of the latter."""
        sums, grams, allowed = gram_sums(words, self.model)
        scores = sums / LONGEST_GRAM
        top = np.where(allowed, scores, -np.inf).max(1, keepdims=True)
        some = np.isfinite(top)
        scores = np.where(allowed, scores - np.where(some, top, 0.0), np.where(some, OUTSIDE_SCRIPT, 0.0))
        return scores, self.reached[:0] if self.levels is None else allowed & (sums / grams[:, None] >= self.levels)

    def places(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


def best_path(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Language of each word on the path with the largest sum of scores less ``penalty`` per switch.

    One language throughout is best when no stretch of words gains more than half the penalty by any other language;
    that test is exact and settles most texts without the recursion.
    """
    best = int(scores.sum(0).argmax())
    gains = np.cumsum(scores - scores[:, [best]], axis=0)
    lowest = np.minimum(np.minimum.accumulate(gains, axis=0), 0.0)
    if (gains - lowest).max() <= penalty / 2:
        return np.full(len(scores), best)
    rows = scores.tolist()
    value, origins = rows[0], []
    for row in rows[1:]:
        top = max(value)
        origin, switched = value.index(top), top - penalty
        origins.append([i if stay >= switched else origin for i, stay in enumerate(value)])
        value = [(stay if stay >= switched else switched) + own for stay, own in zip(value, row)]
    path = [value.index(max(value))]
    for origin in reversed(origins):
        path.append(origin[path[-1]])
    return np.array(path[::-1])


def identify(
    text: str, words: list[str], scorer: WordScorer, penalty: float
) -> tuple[str, float, list[tuple[int, int, str]], float]:
    """(language of most words, score, spans of (start, end, language) in code points, explained); the words must be learned.

    Explained is the share of the words with a letter that reach the level of the language of their span; 0 without levels.
    """
    languages = scorer.model.languages
    if not languages or not any(char.isalpha() for word in words for char in word):
        return UNDETERMINED, 0.0, [], 0.0
    known = scorer.places(words)
    scores = scorer.rows[known]
    path = best_path(scores, penalty)
    shares = np.bincount(path, minlength=len(languages)) / len(path)
    best = int(shares.argmax())
    own = scores[path == best].sum(0)
    posterior = 1.0 / np.exp(np.minimum(own - own[best], 700.0)).sum()
    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
    places = [m.start() for m in WORD.finditer(text)] if len(cuts) > 2 else [0]
    starts = [0, *(places[cut] for cut in cuts[1:-1]), len(text)]
    spans = [(a, b, languages[path[cut]]) for a, b, cut in zip(starts, starts[1:], cuts)]
    explained = 0.0
    if scorer.levels is not None:
        lettered = np.fromiter((any(map(str.isalpha, word)) for word in words), bool, len(words))
        explained = float(scorer.reached[known, path][lettered].mean())
    return languages[best], float(min(1.0, shares[best] * posterior)), spans, explained


def identify_languages(
    df: DataFrame,
    model: LanguageModel,
    key: str = "doc_id",
    text: str = "text",
    penalty: float = SWITCH_PENALTY,
    levels: np.ndarray | None = None,
) -> DataFrame:
    """One row per row: key, lang_pred, score (share of its words times their posterior), n_spans and spans.

    ``spans`` lists start:end:language in code points; together they cover the text. A text that is missing or has no
    letter is ``und`` with score 0 and no span. With ``levels`` (see ``explained_levels``) there is also explained, the share of
    its words with a letter that reach the level of the language of their span; ``und`` has 0. Ties go to the language first in order. Only the text is read, whole;
    repeated rows are labelled one by one, and an empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.log_probs, model.allowed, levels))

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        *parts, own_levels = shared.value
        scorer = WordScorer(LanguageModel(*parts), own_levels)
        for batch in batches:
            texts = [(value or b"").decode() for value in batch["text"]]
            words = [WORD.findall(text) for text in texts]
            scorer.learn(words)
            found = [identify(text, own, scorer, penalty) for text, own in zip(texts, words)]
            yield {
                "key": batch["key"],
                "lang_pred": [x[0] for x in found],
                "score": [x[1] for x in found],
                "n_spans": [len(x[2]) for x in found],
                "spans": [",".join(f"{a}:{b}:{name}" for a, b, name in x[2]) for x in found],
                "explained": [x[3] for x in found],
            }

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, lang_pred string, score double, n_spans long, spans string"
    schema += ", explained double" if levels is not None else ""
    rows = texts_of(df, key, text, valid=True)
    return map_rows(rows, schema, task, WORD_BATCH_BYTES).withColumnRenamed("key", key)


by_value(__name__)
