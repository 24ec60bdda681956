import itertools
import math
import random
import tracemalloc
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tabscope.llm import language
from tabscope.llm.language import best_path, explained_levels, identify_languages, train_language_model
from tabscope.llm.queries import fold, language_model

from .conftest import DOCUMENTS


def value(scores, path, penalty):
    return sum(scores[t][l] for t, l in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-8, 0)] * 3), min_size=1, max_size=6), st.integers(0, 9))
def test_best_path(scores, penalty):
    found = best_path(np.array(scores, float), penalty)
    best = max(value(scores, path, penalty) for path in itertools.product(range(3), repeat=len(scores)))
    assert value(scores, found.tolist(), penalty) == best


def test_held_out_accuracy_and_mixed_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_model(docs)
    rows = identify_languages(docs, model).join(docs.withColumn("held", fold(docs)).select("doc_id", "lang", "held"), "doc_id")
    held = [r for r in rows.collect() if r["held"]]
    assert len(held) > 150 and sum(r["lang_pred"] == r["lang"] for r in held) > 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)
    parts = {r["lang"]: r["text"][:600] for r in docs.where("n_chars > 2000").collect()}
    mixed = spark.createDataFrame([(1, parts["de"] + "\n" + parts["es"] + "\n" + parts["de"], None, None, None)], DOCUMENTS)
    spans = [span.split(":") for span in identify_languages(mixed, model).first()["spans"].split(",")]
    assert [name for _, _, name in spans] == ["de", "es", "de"]
    assert abs(int(spans[0][1]) - 601) < 60 and abs(int(spans[1][1]) - 1202) < 60
    assert [b for _, b, _ in spans[:-1]] == [a for a, _, _ in spans[1:]]


def test_scripts_narrow_candidates(spark):
    rows = [(i, "привет как дела друг", "ru", "s", 1) for i in range(5)] + [(i, "hello how are you friend", "en", "s", 1) for i in range(5)]
    model = train_language_model(spark.createDataFrame(rows, DOCUMENTS))
    texts = [(1, "незнакомое слово", None, None, None), (2, "unknown words", None, None, None), (3, "漢字", None, None, None)]
    texts.append((4, "12 _ ² ½ !", None, None, None))
    found = {r["doc_id"]: r for r in identify_languages(spark.createDataFrame(texts, DOCUMENTS), model).collect()}
    assert (found[1]["lang_pred"], found[2]["lang_pred"]) == ("ru", "en")
    assert (found[4]["lang_pred"], found[4]["score"]) == ("und", 0.0)
    assert found[3]["lang_pred"] in ("ru", "en") and found[3]["score"] <= 0.5


def test_edges(messy, messy_rows, no_documents):
    found = identify_languages(messy, train_language_model(messy)).collect()
    assert len(found) == len(messy_rows)
    by = {r["doc_id"]: r for r in found}
    for key in (1, 2, 3):
        assert (by[key]["lang_pred"], by[key]["score"], by[key]["spans"]) == ("und", 0.0, "")
    empty = train_language_model(no_documents)
    assert identify_languages(no_documents, empty).collect() == []
    assert {r["lang_pred"] for r in identify_languages(messy, empty).collect()} == {"und"}


def test_a_model_has_bounded_languages(spark, monkeypatch):
    from tabscope.llm import language

    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    rows = [(i, "some words of a text", name) for i, name in enumerate(["a", "a", "b", "c", "c", "d"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.train_language_model(df).languages == ["a", "c"]


def test_words_are_held_against_the_language_of_their_span(spark):
    rng = random.Random(5)
    word = {name: lambda letters=letters: "".join(rng.choices(letters, k=rng.randint(3, 6))) for name, letters in (("a", "abcdef"), ("u", "uvwxyz"), ("m", "mnop"))}
    rows = [(i, " ".join(word[name]() for _ in range(60)), name, "s", 1) for i in range(60) for name in ("a", "u")]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    model = train_language_model(docs)
    levels = explained_levels(docs, model)
    halves = " ".join([*(word["a"]() for _ in range(60)), *(word["u"]() for _ in range(40))])
    texts = [(1, halves), (2, " ".join(word["m"]() for _ in range(50))), (3, "12 ½"), (4, None), (5, word["a"]() + " ½ 7")]
    given = spark.createDataFrame([(key, text, None, None, None) for key, text in texts], DOCUMENTS)
    spans = {r["doc_id"]: r for r in identify_languages(given, model, levels=levels).collect()}
    assert spans[1]["explained"] > 0.9 and [x.split(":")[2] for x in spans[1]["spans"].split(",")] == ["a", "u"]
    assert [spans[key]["explained"] for key in (2, 3, 4)] == [0, 0, 0] and spans[5]["explained"] in (0, 1)
    # Held in one language by the penalty, the words of the other are not explained.
    whole = {r["doc_id"]: r for r in identify_languages(given, model, penalty=1e9, levels=levels).collect()}
    assert whole[1]["n_spans"] == 1 and 0.5 < whole[1]["explained"] <= 0.6
    shares = {r["doc_id"]: r["explained"] for r in language.explained_shares(given, model, levels).collect()}
    assert shares == {key: r["explained"] for key, r in spans.items()}
    assert "explained" not in identify_languages(given, model).columns


def test_words_are_scored_in_blocks():
    rng = np.random.default_rng(7)
    probs = np.log(rng.random((3, language.CELLS)) + 0.1)
    model = language.LanguageModel(["a", "b", "c"], probs, np.ones((3, len(language.SCRIPTS)), bool))
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 10)) for _ in range(40_000)]
    scorer = language.WordScorer(model, np.full(3, -1.0))
    tracemalloc.start()
    scorer.learn([words])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6  # 82 MB when all n-grams are laid out together
    assert len(scorer.rows) == len(scorer.reached) == len(set(words))
    sums, grams, _ = language.gram_sums(words, model)
    at = scorer.places(words)
    assert np.array_equal(scorer.rows[at], sums / language.LONGEST_GRAM - (sums / language.LONGEST_GRAM).max(1, keepdims=True))
    assert np.array_equal(scorer.reached[at], sums / grams[:, None] >= -1.0)
    blocks = list(language.word_blocks(words))
    assert sum(blocks, []) == words and max(map(len, blocks)) == language.WORDS_AT_ONCE


def test_model_and_levels_come_from_all_labelled_rows(spark, monkeypatch):
    rng = random.Random(11)
    row = {"a": lambda: " ".join("".join(rng.choices("abcd", k=rng.randint(1, 9))) for _ in range(3)), "u": lambda: "banana ½ uvu été"}
    texts = [(name, row[name]()) for name, n in (("a", 2500), ("u", 1200)) for _ in range(n)]
    keys = [None if i % 3 == 0 else i % 50 for i in range(len(texts))]
    rows = [(key, text, name) for key, (name, text) in zip(keys, texts)] + [(1, None, "a"), (2, "left out", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = train_language_model(docs)
    levels = explained_levels(docs, model)
    for i, name in enumerate(["a", "u"]):
        words = Counter(word for own, text in texts if own == name for word in text.split())
        cells = {word: Counter(language.gram_cells([word])[1].tolist()) for word in words}
        seen = Counter()
        for word, times in words.items():
            seen.update({cell: n * times for cell, n in cells[word].items()})
        total = seen.total() + 0.5 * language.CELLS
        assert math.isclose(model.totals[i, 0], total)
        means = []
        for word, times in words.items():
            size = cells[word].total()
            logs = [n * math.log((seen[cell] - n + 0.5) / (total - size)) for cell, n in cells[word].items()]
            means += [sum(logs) / size] * times * any(map(str.isalpha, word))
        last = sorted(means, reverse=True)[math.ceil(0.98 * len(means)) - 1]
        assert levels[i] == -(math.floor(-last * language.BINS_PER_UNIT) + 1) / language.BINS_PER_UNIT
    monkeypatch.setattr(language, "REMEMBERED_WORDS", 5)
    again = train_language_model(docs)
    assert np.array_equal(again.log_probs, model.log_probs) and np.array_equal(explained_levels(docs, again), levels)
