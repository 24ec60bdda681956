import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tabscope.llm.mixing import capped_targets, mix_copies, mix_sources

from .conftest import prose

SCHEMA = "doc_id long, text string, source string"


def filled(sizes, weights, total, cap):
    """Targets by the definition: share, cut what is above the cap, share the excess again."""
    target, free = {s: 0.0 for s in sizes}, set(sizes)
    left = total
    while free:
        weight = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / weight > cap * sizes[s]}
        if not over:
            target.update({s: left * weights[s] / weight for s in free})
            break
        for s in over:
            target[s] = cap * sizes[s]
        left, free = left - sum(cap * sizes[s] for s in over), free - over
    return target


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute(rows, seed=42):
    sources = sorted({s for *_, s in rows if s is not None}) + [None] * any(s is None for *_, s in rows)
    sizes = {s: sum(size(t) for _, t, own in rows if own == s) for s in sources}
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    targets = filled(sizes, weights, 1.5 * sum(sizes.values()), 2.0)
    copies = {}
    for s in sources:
        own = [(size(t), k, t) for k, t, o in rows if o == s]
        whole = math.floor(targets[s] / sizes[s]) if sizes[s] else 0
        owed, rest = targets[s] - whole * sizes[s], sizes[s]
        for cls in range(47, -1, -1):
            members = [x for x in own if (x[0].bit_length() - 1 if x[0] else 0) == cls]
            limit = math.floor(min(max(owed / rest, 0), 1) * 4096 + 0.5) if rest else 0
            for n, k, t in members:
                inner = hashlib.md5((t or "").encode()).hexdigest()
                digest = hashlib.md5(f"{seed}|{'' if k is None else k}|{inner}".encode()).hexdigest()
                extra = bool(sizes[s]) and int(digest[:3], 16) < limit
                copies[s, k, t] = whole + extra
                owed -= n * extra
                rest -= n
    return sorted(
        ((k, size(t), sizes[s], round(targets[s], 6), size(t) * copies[s, k, t]) for k, t, s in rows), key=str
    )


def got(df, **settings):
    rows = mix_copies(df, (3, 1, 2), **settings).collect()
    return sorted(
        ((r["doc_id"], r["mix_size"], r["mix_source_size"], round(r["mix_target"], 6), r["mix_size"] * r["mix_copies"]) for r in rows),
        key=str,
    )


def corpus(seed=1):
    rng = random.Random(seed)
    rows = [(i, prose(i, rng.choice([1, 3, 20, 90])), rng.choice("aaaaabcdeé") if i % 9 else None) for i in range(600)]
    return rows + [(7000, prose(3, 4000), "b"), (7001, None, "zz"), (7002, "", "zz"), (7003, " \t", "a")]


def test_copies_match_brute_force(spark):
    rows = corpus()
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(7)) == brute(rows)


def test_taken_words_are_near_the_target(spark):
    taken = mix_copies(spark.createDataFrame(corpus(2), SCHEMA), (3, 1, 2)).groupBy("source").agg(
        F.first("mix_target").alias("target"), F.sum(F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.max("mix_copies").alias("most")
    )
    for row in taken.collect():
        assert row["most"] <= 2
        if row["source"] != "b":  # one document holds most of b
            assert abs(row["taken"] - row["target"]) <= 0.02 * row["target"] + 2


@pytest.mark.parametrize("sizes", [{"a": 5, "b": 1000, "c": 1}, {"a": 1, "b": 1, "c": 1, "d": 10**9}, {"a": 0, "b": 7}, {"a": 0}])
def test_targets(spark, sizes):
    weights = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(sorted(sizes))}
    df = spark.createDataFrame([(s, n, weights[s]) for s, n in sizes.items()], "source string, source_size long, weight double")
    want = filled(sizes, weights, 1.5 * sum(sizes.values()), 2.0)
    assert {r["source"]: pytest.approx(r["target"]) for r in capped_targets(df, 1.5, 2.0).collect()} == want


def test_edges(spark, messy, messy_rows, no_documents):
    rows = [(row[0], row[1], row[3]) for row in messy_rows]
    assert got(messy.drop("n")) == brute(rows)
    assert mix_copies(no_documents, (3, 1, 2)).collect() == []
    inner = {name: F.lit(name) for name in ("size", "step", "cls", "steps", "target", "whole", "source_size", "weight", "words")}
    assert got(messy.withColumns(inner)) == brute(rows)
    mixed = mix_sources(messy, (3, 1, 2))
    assert mixed.columns == messy.columns
    copies = sum(r["mix_copies"] for r in mix_copies(messy, (3, 1, 2)).collect())
    assert mixed.count() == copies
    with pytest.raises(ValueError, match="mix_size"):
        mix_copies(messy.withColumn("mix_size", F.lit(1)), (3, 1, 2))
    broken = spark.range(2).select(F.col("id").alias("doc_id"), F.expr("cast(X'61FF2062' as string)").alias("text"), F.lit("s").alias("source"))
    assert [row[1] for row in got(broken)] == [2, 2]
