import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscope.llm import search
from tabscope.llm.search import owners_of, ranked_search

from .conftest import CLASHING, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, top):
    own = [(key, Counter(terms(text))) for key, text in docs]
    own = [(key, counts, sum(counts.values())) for key, counts in own if counts]
    n_docs, n_terms = len(own), sum(n for *_, n in own)
    df = Counter(term for _, counts, _ in own for term in counts)
    found = []
    for item, text in items:
        scores = []
        for key, counts, n in own:
            m = 25 + (75 * n * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 8 * m))
                for t in terms(text)
                if t in counts
            )
            if score > 0:
                scores.append((-score, key is None, key or 0, key))
        found += [(item, rank, key, -score) for rank, (score, _, _, key) in enumerate(sorted(scores, key=lambda x: x[:3])[:top], 1)]
    return sorted(found, key=str)


def got(docs, items, **settings):
    return sorted(map(tuple, ranked_search(docs, items, **settings).collect()), key=str)


def corpus():
    rng = random.Random(8)
    docs = [(i, prose(i % 70, rng.choice([1, 5, 40, 200]))) for i in range(400)]
    docs += [(1000 + i, prose(7, 30)) for i in range(40)]  # ties over many copies
    docs += [(i, "Common " * rng.randrange(1, 9) + prose(i, 3)) for i in range(2000, 2200)]
    items = [(i, prose(i * 3, 25)) for i in range(12)] + [(50, "common COMMON alpha1"), (51, None), (52, "zzz"), (52, "zzz common"), (53, "")]
    return docs, items


@pytest.mark.parametrize(("owners", "block", "bundle", "wave"), [(1, 4096, 256, 1 << 20), (4, 64, 5, 1 << 20), (3, 9, 2, 800)])
def test_ranks_match_brute_force(spark, monkeypatch, owners, block, bundle, wave):
    monkeypatch.setattr(search, "BLOCK_DOCS", block)
    monkeypatch.setattr(search, "BUNDLE_ITEMS", bundle)
    docs, items = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert got(df, asked, top=10, owners=owners, wave_bytes=wave) == brute(docs, items, 10)


def test_edges(spark, messy, messy_rows, no_documents):
    items = [(1, "alpha1 é漢字 ONE two"), (None, "текст mixed no key"), (3, None)]
    asked = spark.createDataFrame(items, "item_id long, text string")
    extra = asked.withColumns({name: F.lit(value) for name, value in CLASHING.items()})
    assert got(messy, extra, top=3) == brute([row[:2] for row in messy_rows], items, 3)
    assert got(no_documents, asked) == got(messy, asked.limit(0)) == []
    broken = spark.range(3).select(F.col("id").alias("doc_id"), F.expr("cast(X'61FF2062' as string)").alias("text"))
    same = broken.limit(1).select(F.col("doc_id").alias("item_id"), "text")
    assert [row[2] for row in got(broken, same)] == [0, 1, 2]
    named = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y"), ("c", "q")], "doc_id string, text string")
    one = spark.createDataFrame([("i", "x")], "item_id string, text string")
    assert [row[1:3] for row in got(named, one)] == [(1, "a"), (2, "b"), (3, None)]


def test_owners_share_the_postings():
    lengths = np.array([100, 1, 1, 1, 50, 50, 2])
    owner = owners_of(np.array([1, 9, 8, 7, 3, 2, 6]), lengths, 2)
    assert owner.tolist() == [1, 0, 0, 0, 0, 0, 0]
    assert owners_of(np.zeros(1, np.int64), np.zeros(1, np.int64), 4).tolist() == [0]
