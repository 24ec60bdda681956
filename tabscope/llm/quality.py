"""Quality rules as a short-circuit cascade, ordered by rejection per cost on a sample."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import by_value, map_rows, texts_of

WHITE = bytes(range(9, 14)) + b" "
SYMBOLS = b"#*$%&|<>"
# White space and the continuation bytes of UTF-8, which start no character.
NO_WORD_CHARACTER = WHITE + bytes(range(0x80, 0xC0))
SAMPLE_ROWS = 2_000


class Text:
    """Features of one whole text (missing text: empty), each computed when first asked for.

    Words are runs without ASCII white space; counts of characters are of code points.
    """

    def __init__(self, text: bytes | None):
        self.text = text or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text.translate(None, NO_WORD_CHARACTER))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.text.split(b"\n") if line and not line.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a three-word window that occurs at least twice."""
        if self.n_words < 4:
            return 0
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(word, len(known)) for word in self.words], np.int64)
        codes = ids[:-2] * len(known) + ids[1:-1]
        if len(known) > 2_000_000:  # three ids would not fit into 64 bits
            codes = np.unique(codes, return_inverse=True)[1]
        codes = codes * len(known) + ids[2:]
        _, place, counts = np.unique(codes, return_inverse=True, return_counts=True)
        if len(counts) == len(codes):
            return 0
        again = counts[place] > 1
        covered = np.zeros(len(ids), bool)
        for shift in range(3):
            covered[shift : shift + len(again)] |= again
        return int(covered.sum())

    @cached_property
    def n_lettered_words(self) -> int:
        """Words with a letter of any script: some byte that is an ASCII letter or not ASCII."""
        return sum(not word.translate(None, NOT_LETTERS) == b"" for word in self.words)


NOT_LETTERS = bytes(b for b in range(0x80) if not chr(b).isalpha())


@dataclass(frozen=True)
class Rule:
    """A text fails the rule when ``fails`` holds."""

    name: str
    fails: Callable[[Text], bool]


# Thresholds of published web-text filters, loosened where languages with long words would suffer.
BASE_RULES = (
    Rule("few_words", lambda t: t.n_words < 50),
    Rule("repeats", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda t: 10 * t.n_symbols > 3 * t.n_words),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words),
    Rule("repeated_lines", lambda t: 2 * t.n_dup_lines > len(t.lines)),
    Rule("letters", lambda t: 10 * t.n_lettered_words < 7 * t.n_words),
)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def estimate_rules(
    df: DataFrame, rules: Sequence[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 7
) -> list[dict]:
    """Cost (seconds) and rejection (share) of each rule alone, on a random sample of about ``sample_rows`` rows."""
    rows = df.count()
    share = min(1.0, 2.0 * sample_rows / max(rows, 1))

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        seconds, rejected, n = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            n += len(batch["text"])
            for i, rule in enumerate(rules):
                start = time.perf_counter()
                rejected[i] += sum(rule.fails(Text(value)) for value in batch["text"])
                seconds[i] += time.perf_counter() - start
        yield {"rule": list(range(len(rules))), "seconds": seconds, "rejected": rejected, "n": [n] * len(rules)}

    sample = df.select(F.col(f"`{text}`").cast("binary").alias("text")).sample(share, seed).limit(sample_rows)
    measured = map_rows(sample, "rule int, seconds double, rejected long, n long", task)
    sums = measured.groupBy("rule").agg(*[F.sum(name).alias(name) for name in ("seconds", "rejected", "n")]).collect()
    return [
        {"rule": rules[row["rule"]].name, "cost": row["seconds"] / max(row["n"], 1), "rejection": row["rejected"] / max(row["n"], 1)}
        for row in sums
    ]


def order_rules(rules: Sequence[Rule], estimates: list[dict]) -> list[Rule]:
    """Most rejection per cost first; a rule without an estimate (empty sample) keeps its place at the end."""
    gain = {e["rule"]: e["rejection"] / max(e["cost"], 1e-9) for e in estimates}
    return sorted(rules, key=lambda rule: -gain.get(rule.name, -1.0))


def quality_cascade(
    df: DataFrame,
    rules: Sequence[Rule] = RULES,
    key: str = "doc_id",
    text: str = "text",
    report: Sequence[str] = (),
    verdicts: dict[str, Sequence[Rule]] | None = None,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per row: key, the ``report`` features, the ``verdicts`` (failing any of their rules), and ``kept``.

    Rules run in the estimated order and stop at the first that fails, so later ones cost nothing for that text; a
    feature is computed once and only when a rule or the report asks for it. The order changes the cost only, never
    ``kept``. A missing text counts as empty, repeated rows are judged one by one, other columns of ``df`` are ignored,
    and an empty table gives an empty result. Texts are read whole.
    """
    ordered = order_rules(rules, estimate_rules(df, rules, text, sample_rows))
    verdicts = dict(verdicts or {})

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {"key": batch["key"], "kept": []}
            out |= {name: [] for name in (*report, *verdicts)}
            for value in batch["text"]:
                features = Text(value)
                out["kept"].append(not any(rule.fails(features) for rule in ordered))
                for name in report:
                    out[name].append(getattr(features, name))
                for name, some in verdicts.items():
                    out[name].append(any(rule.fails(features) for rule in some))
            yield out

    fields = [f"key {df.schema[key].dataType.simpleString()}"]
    fields += [f"{name} long" for name in report] + [f"{name} boolean" for name in verdicts] + ["kept boolean"]
    return map_rows(texts_of(df, key, text), ", ".join(fields), task).withColumnRenamed("key", key)


by_value(__name__)
