from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tabscope.llm.quality import BASE, BASE_RULES, RULES, Rule, Text, estimate_rules, order_rules, quality_cascade


def brute(text):
    data = (text or "").encode()
    words = data.split()
    grams = Counter(zip(words, words[1:], words[2:]))
    repeated = {
        k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)
    }
    seen, dup = set(), 0
    for line in data.split(b"\n"):
        if line.split():
            dup += line in seen
            seen.add(line)
    chars = sum(len(word.decode()) for word in words)
    return len(words), chars, sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(repeated)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.none(), st.lists(st.sampled_from(["a", "b", "c#", " ", "\n", "\t", "é|", "\x1c", "\x85"])).map("".join)))
def test_features_match_brute_force(text):
    features = Text(None if text is None else text.encode())
    assert tuple(getattr(features, name) for name in BASE) == brute(text)


def test_cascade(messy, messy_rows, no_documents):
    rows = quality_cascade(messy, report=BASE, verdicts={"base_failed": BASE_RULES}).collect()
    got = Counter((r["doc_id"], *(r[name] for name in BASE), r["base_failed"], r["kept"]) for r in rows)
    want = Counter()
    for doc, text, *_ in messy_rows:
        b = brute(text)
        base = b[0] < 50 or 100 * b[4] > 50 * b[0]
        kept = not any(rule.fails(Text(None if text is None else text.encode())) for rule in RULES)
        assert kept <= (not base)
        want[(doc, *b, base, kept)] += 1
    assert got == want
    assert quality_cascade(no_documents).collect() == []


def test_order_follows_rejection_per_cost_and_not_the_result(messy):
    estimates = estimate_rules(messy, RULES)
    assert {e["rule"] for e in estimates} == {rule.name for rule in RULES}
    assert all(e["cost"] > 0 and 0 <= e["rejection"] <= 1 for e in estimates)
    a, b, c = (Rule(name, lambda t: False) for name in "abc")
    made = [{"rule": "a", "cost": 1.0, "rejection": 0.2}, {"rule": "b", "cost": 0.1, "rejection": 0.1}]
    assert [r.name for r in order_rules([a, b, c], made)] == ["b", "a", "c"]
    kept = {tuple(r) for r in quality_cascade(messy, RULES).collect()}
    assert kept == {tuple(r) for r in quality_cascade(messy, RULES[::-1]).collect()}


def test_ordinary_prose_is_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = quality_cascade(docs, report=("n_words", "n_symbols"), verdicts={"base": BASE_RULES}).collect()
    plain = [r for r in rows if not r["base"] and r["n_symbols"] == 0]
    assert len(plain) > 50 and sum(r["kept"] for r in plain) > 0.97 * len(plain)
