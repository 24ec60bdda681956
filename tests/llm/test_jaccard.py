import random
from collections import Counter

import pytest

from tabscope.llm.jaccard import WordHashes, _adaptive_index, _counted, jaccard_components, shingle_set
from tabscope.session import stage

from .conftest import DOCUMENTS, prose

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text):
    words = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """Components over all pairs, by row; a key is a document."""
    sets = [(row[0], shingles(row[1])) for row in rows]
    group = list(range(len(sets)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                group[root(i)] = root(j)
    least = {}
    for i, (key, own) in enumerate(sets):
        if key is not None:
            least[root(i)] = min(least.get(root(i), key), key)
    return sorted((str(key), len(own), str(least.get(root(i)) if own else key)) for i, (key, own) in enumerate(sets))


def got(df, **settings):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard_components(df, **settings).collect())


def corpus(seed):
    """Copies with edits at random places, chains of edits, and passages that unrelated texts share."""
    rng = random.Random(seed)
    rows, passage = [], prose(seed, 60)
    for base in range(8):
        words = prose(seed * 100 + base, rng.choice([12, 60, 150])).split()
        for _ in range(rng.choice([1, 2, 25])):
            copy = list(words)
            for _ in range(rng.randrange(7)):
                copy[rng.randrange(len(copy))] = rng.choice(["new", f"edit{rng.randrange(10**6)}"])
            rows.append(" ".join(copy))
            if rng.random() < 0.3:
                words = copy
    rows += [f"{prose(seed * 7 + i, rng.choice([3, 15, 60]))} {passage}" for i in range(40)]
    rows += [passage.upper()] * 3
    rng.shuffle(rows)
    return [(rng.choice([1, 10]) * 1000 + i, text, "en", "s", 1) for i, text in enumerate(rows)]


@pytest.mark.parametrize(("seed", "long_list"), [(1, 2), (2, 4), (3, 50)])
def test_components_match_brute_force(spark, seed, long_list):
    rows = corpus(seed)
    assert got(spark.createDataFrame(rows, DOCUMENTS), long_list=long_list) == brute(rows)


def test_edges(messy, messy_rows, no_documents):
    rows = [row for row in messy_rows]
    assert got(messy, long_list=2) == brute(rows)
    assert jaccard_components(no_documents).collect() == []


def test_shingles_of_short_and_equal_texts():
    known = WordHashes()
    assert len(shingle_set(b"", known, 5)) == len(shingle_set(None, known, 5)) == 0
    assert (shingle_set(b"A b\tC", known, 5) == shingle_set(b"a B c", known, 5)).all()
    assert len(shingle_set(b"a b c d e f", known, 5)) == 2
    assert shingle_set(b"a b", known, 5)[0] != shingle_set(b"b a", known, 5)[0]


def test_tokens_are_counted_where_they_lie(spark):
    rng = random.Random(8)
    tokens = [rng.choice([7, -7, rng.randrange(-300, 300), rng.randrange(10**12)]) for _ in range(30_000)]
    rows = stage(spark.createDataFrame(list(zip(tokens, range(30_000), map(float, tokens))), "token long, node long, x double"), "postings")
    held = Counter(tokens)
    wanted = sorted((token, node, float(token), held[token]) for node, token in enumerate(tokens) if held[token] > 1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for least, batch in ((1000, 10_000), (10**9, 10_000), (10**9, 100), (30, 100)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            assert sorted(map(tuple, _counted(rows, "df", least).collect())) == wanted
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert _counted(rows.where("token > 10"), "df").schema["df"].dataType.simpleString() == "bigint"
    assert _counted(rows.limit(0), "df").collect() == []


def test_sets_of_one_large_group_are_ordered_without_a_join(spark):
    rows = [(i, 40, [*range(30), *range(1000 + 10 * i, 1010 + 10 * i)]) for i in range(1500)]
    sets = stage(spark.createDataFrame(rows, "node long, n long, tokens array<long>"), "sets")
    index = _adaptive_index(sets, 75)
    assert "Join" not in index._jdf.queryExecution().executedPlan().toString()
    found = index.collect()
    assert {r["u"] for r in found} == {10} and {r["token"] for r in found} <= set(range(30))
    assert len({r["node"] for r in found}) == 1500
