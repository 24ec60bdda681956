import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabscope.llm.alignment import Aligner, Csr, align_tokenizers, byte_tokens, shared_groups, token_bytes

from .conftest import prose

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "a  b\n c\x00d <|endoftext|> é漢", "  two spaces before and after  ", "x\n \n y", " \t\t z", "it's 's ''S 2.0 10,5", " ",
    "tabs\tand no-break 　wide", "漢字仮名交じり文 текст 漢字", "▁ not restored", "ab ▁", "word" * 300, "́ a ́b", "é" * 3000,
    "a_b _c  _d ​e \x1cf \x85g", "🙂🙂 🙂 emoji👩‍👩‍👧", "\n", "    four\n\n\n  lines \r\n end \n", "<s> </s> <0x41> <unk>",
]


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1]), Aligner(*PATHS)


def groups_of(text, both):
    """Groups of (ids of A, ids of B) by the definition, over the whole text; none where bytes are not restored."""
    a, b, tables = both
    if not text:
        return []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw = (" " + text).encode()
    if not b"".join(tables.bytes_a[i] for i in ids_a) == raw == b"".join(tables.bytes_b[i] for i in ids_b):
        return []
    ends_a, ends_b = (np.cumsum(own[ids]) for own, ids in ((tables.length_a, ids_a), (tables.length_b, ids_b)))
    at = {int(end): i for i, end in enumerate(sorted(set(ends_a.tolist()) & set(ends_b.tolist())))}
    groups = [([], []) for _ in at]
    for side, (ids, ends) in enumerate(((ids_a, ends_a), (ids_b, ends_b))):
        group = 0
        for i, end in zip(ids, ends.tolist()):
            groups[group][side].append(i)
            group += end in at
    return groups


def brute(rows, both):
    aligned = [(key, groups_of(text, both)) for key, text in rows]
    links = [Counter((x, y) for own_a, own_b in groups for x in own_a for y in own_b) for _, groups in aligned]
    counts = Counter(pair for own in links for pair in own)
    highest = {}
    for (x, _), n in counts.items():
        highest[x] = max(highest.get(x, 0), n)
    out = []
    for (key, groups), own in zip(aligned, links):
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((
            key, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(own.values()),
            sum(n for pair, n in own.items() if counts[pair] == highest[pair[0]]), sum(n * counts[pair] for pair, n in own.items()),
            hashlib.sha256(spelled.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=str)


def got(df):
    names = "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    return sorted(((r["doc_id"], *[r[name] for name in names]) for r in align_tokenizers(df, *PATHS).collect()), key=str)


def test_products_of_rows():
    rng = np.random.default_rng(3)
    left, right = rng.integers(0, 3, (40, 30)), rng.integers(0, 3, (30, 50))

    def csr(m):
        rows, columns = m.nonzero()
        return Csr.of(rows, columns, *m.shape, m[rows, columns])

    product = csr(left).times(csr(right))
    dense = np.zeros((40, 50), np.int64)
    dense[product.rows(), product.columns] = product.values
    assert (dense == left @ right).all()


def test_overlaps_and_groups():
    ends_a, ends_b = np.array([2, 5, 6, 9]), np.array([2, 3, 6, 7, 8, 9])
    overlaps = token_bytes(ends_a).times(byte_tokens(ends_b))
    assert list(zip(overlaps.rows(), overlaps.columns, overlaps.values)) == [
        (0, 0, 2), (1, 1, 1), (1, 2, 2), (2, 2, 1), (3, 3, 1), (3, 4, 1), (3, 5, 1)
    ]
    of_a, of_b = shared_groups(ends_a, ends_b)
    assert (of_a.tolist(), of_b.tolist()) == ([0, 1, 1, 2], [0, 1, 1, 2, 2, 2])


def test_chunks_equal_the_whole_text(both):
    rng = random.Random(5)
    letters = [" ", " ", "  ", "\n", "a", "the", "'s", "é", "漢", "1", ".", "\t", "ing", "_", " \n", "🙂"]
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    facts, digests, _ = both[2].align([text.encode() for text in texts])
    for text, fact, digest in zip(texts, facts.tolist(), digests):
        groups = groups_of(text, both)
        assert fact[:3] == [sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups)], text
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        assert digest == (hashlib.sha256(spelled.encode()).hexdigest() if groups else ""), text


def test_rows_match_brute_force(spark, both):
    rows = [(i, text) for i, text in enumerate([*ODD, None, "", *[prose(seed, 40) for seed in range(20)], prose(1, 40)])]
    rows += [(3, "a repeated key"), (3, "a repeated key"), (None, "no key")]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows, both)


def test_edges(spark, messy, messy_rows, no_documents, both):
    assert got(messy) == brute([row[:2] for row in messy_rows], both)
    assert got(no_documents) == []
    broken = spark.range(2).select(F.col("id").alias("doc_id"), F.expr("cast(X'61FF2062' as string)").alias("text"))
    assert got(broken) == [(0, 0, 0, 0, 0, 0, 0, ""), (1, 0, 0, 0, 0, 0, 0, "")]
