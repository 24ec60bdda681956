import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tabscope.llm.decontaminate import GAP, MATCH, MISMATCH, align, contaminated

from .conftest import prose

DOC = "doc_id long, text string, item string, score int"
ITEM = "item_id long, text string, key string"


def plain_score(item, passage):
    rows = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            step = MATCH if a == b else MISMATCH
            rows[i][j] = max(0, rows[i - 1][j - 1] + step, rows[i - 1][j] + GAP, rows[i][j - 1] + GAP)
    return max(map(max, rows))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(-1, 4), max_size=20))
def test_alignment_score(item, passage):
    score, first, end = align(np.array(item, np.int64), np.array(passage, np.int64))
    # A word outside the benchmark (-1) never equals one of an item.
    assert score == plain_score(item, passage)
    if score:
        assert 0 <= first < end <= len(passage) and plain_score(item, passage[first:end]) == score


def edited(text, every):
    words = text.split()
    return " ".join("changed" if i % every == every - 1 else word for i, word in enumerate(words))


def test_copies_are_found_and_others_left(spark):
    items = [(i, prose(1000 + i, 25)) for i in range(30)] + [(30, None), (31, ""), (32, "two words"), (33, prose(1000, 25))]
    docs = [(i, prose(i, 200), "x", 0) for i in range(100)]
    docs += [(200 + i, f"{prose(i, 60)} {items[i][1].upper()}! {prose(i + 1, 60)}", "x", 0) for i in range(10)]
    docs += [(300 + i, f"{prose(i, 60)} {edited(items[i][1], 5)} {prose(i + 1, 60)}", "x", 0) for i in range(10)]
    docs += [(400, None, "x", 0), (401, "", "x", 0), (402, items[5][1], "x", 0), (402, items[5][1], "x", 0), (None, items[6][1], "x", 0)]
    docs += [(500, prose(77, 40_000) + " " + items[7][1], "x", 0)]
    benchmark = spark.createDataFrame([(*item, "k") for item in items], ITEM)
    documents = spark.createDataFrame(docs, DOC)
    want = sorted(
        [(str(200 + i), i) for i in range(10)] + [(str(300 + i), i) for i in range(10)] + [("402", 5)] * 2
        + [("None", 6), ("500", 7), ("200", 33), ("300", 33)]
    )
    for block in (20_000, 7):
        found = contaminated(documents, benchmark, block_items=block).collect()
        assert sorted((str(r["doc_id"]), r["item_id"]) for r in found) == want
    exact = [r for r in found if r["doc_id"] == 201]
    assert exact[0]["score"] == 1.0 and (exact[0]["first_word"], exact[0]["end_word"]) == (60, 85)
    assert contaminated(documents, benchmark.limit(0)).collect() == []
    assert contaminated(documents.limit(0), benchmark).collect() == []


def test_an_item_that_a_third_of_documents_hold(spark):
    item = prose(4242, 30)
    docs = [(i, f"{prose(i, 50)} {item if i % 3 == 0 else prose(i + 5000, 30)}", "x", 0) for i in range(300)]
    found = contaminated(spark.createDataFrame(docs, DOC), spark.createDataFrame([(1, item, "k")], ITEM)).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(0, 300, 3))


def pairs(spark, docs, items):
    documents = spark.createDataFrame([(*doc, "x", 0) for doc in docs], DOC)
    found = contaminated(documents, spark.createDataFrame([(*item, "k") for item in items], ITEM)).collect()
    return sorted((r["doc_id"], r["item_id"]) for r in found)


def test_parts_of_long_items_are_found(spark):
    long, words = prose(9000, 500), prose(9000, 500).split()
    question = prose(9001, 20)
    common = " ".join(prose(1, 300).split()[i % 7] for i in range(40))
    items = [(1, long), (2, f"{prose(9002, 150)} {question}"), (3, f"{prose(9003, 20)} {common}")]
    docs = [(i, prose(i, 200)) for i in range(20)]
    docs += [(100, f"{prose(50, 80)} {' '.join(words[150:350])} {prose(51, 80)}"), (101, f"{prose(52, 80)} {question.upper()}?")]
    docs += [(102, f"{prose(53, 60)} {' '.join(words[40:53])} {prose(54, 30)} {' '.join(words[83:96])} {prose(55, 60)}")]
    docs += [(103, f"{prose(56, 60)} {' '.join(words[40:46])} {prose(57, 60)}"), (104, f"{prose(58, 60)} {common[: len(common) // 2]}")]
    assert pairs(spark, docs, items) == [(100, 1), (101, 2), (102, 1), (104, 3)]


def test_short_items_and_scripts_without_spaces(spark):
    items = [(1, "Fermat"), (2, "Noether's"), (3, "中国的首都是哪里"), (4, "ประเทศไทย"), (5, "the “second” law—of motion’s end"), (6, "日本")]
    docs = [(i, prose(i, 60)) for i in range(20)]
    docs += [(100, f"{prose(50, 9)}, FERMAT. {prose(51, 9)}"), (101, f"{prose(52, 9)} (Noether’s) {prose(53, 9)}"), (102, "Noether")]
    docs += [(103, "他问：中国的首都是哪里？我不知道。"), (104, "ในประเทศไทยมี"), (105, 'now the "second" law - of motion\'s end is'), (106, "在日本国"), (107, "本日")]
    assert pairs(spark, docs, items) == [(100, 1), (101, 2), (103, 3), (104, 4), (105, 5), (106, 6)]
