"""Secret scans: known forms, and random strings by their token efficiency."""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import by_value, map_rows, texts_of

# The known forms. Only the key words match in either case.
ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

# Every access key, digest or random string lies in such a run.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
# Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
# Dates and years, joined by separators.
DATES = re.compile(r"(19|20)[0-9]{2}([-/_]((19|20)[0-9]{2}|[0-3]?[0-9]))*")
# A run that is not random is cut at the first of these that it holds, and each piece is tested alone.
SEPARATORS = "=/_-+"
LEAST_RANDOM = 16
CHARS_PER_TOKEN = 2.2
# A run is encoded in slices, so that the cost is in proportion to its length.
SLICE = 512


def _encoding(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def is_known_identifier(run: str, known: frozenset[str]) -> bool:
    """Digests by their length, UUIDs, dates, given values, and digits that count up one by one."""
    digest = len(run) in DIGEST_LENGTHS and DIGEST.fullmatch(run)
    counting = run.isdigit() and all((int(b) - int(a)) % 10 == 1 for a, b in zip(run, run[1:]))
    return bool(run in known or UUID.fullmatch(run) or digest or counting or DATES.fullmatch(run))


def random_parts(at: int, run: str, free, efficient, known: frozenset[str]) -> list[tuple[int, int, int]]:
    """Spans of the random strings of a run that begins at ``at``: the run itself, or those of its pieces.

    ``free`` tells whether a span overlaps no known form, ``efficient`` whether a string is made of long tokens.
    """
    if len(run) < LEAST_RANDOM or is_known_identifier(run, known):
        return []
    end = at + len(run)
    if free(at, end) and any(map(str.isalnum, run)) and not efficient(run):
        return [(at, 3, end)]
    cut = next((x for x in SEPARATORS if x in run), None)
    spans = []
    for piece in run.split(cut) if cut else ():
        spans += random_parts(at, piece, free, efficient, known)
        at += len(piece) + 1
    return spans


def find_spans(text: str, encoding, chars_per_token: float, known: frozenset[str]) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, sorted; kinds are places in ``KINDS``. Random strings overlap no other span.

    A run longer than ``SLICE`` characters is encoded in slices of that length, so its tokens are those of its slices: at
    most one more a slice than those of the whole run. Random strings have ``LEAST_RANDOM`` characters at least.
    """
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_VALUE]
    runs = [(m.start(), m[0]) for m in RUN.finditer(text)]
    for at, run in runs:
        for kind, form, least in ((1, ACCESS, LEAST_ACCESS), (2, HEX, LEAST_HEX)):
            spans += [(at + m.start(), kind, at + m.end()) for m in form.finditer(run) if len(m[0]) >= least]
    taken = sorted(spans)
    starts, reach = [start for start, _, _ in taken], list(accumulate((stop for _, _, stop in taken), max))

    def free(at: int, end: int) -> bool:
        before = bisect_left(starts, end)
        return not before or reach[before - 1] <= at

    def efficient(run: str) -> bool:
        tokens = sum(len(encoding.encode_ordinary(run[i : i + SLICE])) for i in range(0, len(run), SLICE))
        return len(run) >= chars_per_token * tokens

    for at, run in runs:
        spans += random_parts(at, run, free, efficient, known)
    return sorted(spans)


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_secrets(
    df: DataFrame,
    ranks_path: str,
    pattern: str,
    key: str = "doc_id",
    text: str = "text",
    chars_per_token: float = CHARS_PER_TOKEN,
    known: frozenset[str] = frozenset(),
) -> DataFrame:
    """One row per row: key, spans (kind:start:end, comma-joined), the known forms alone as base_spans, and counts.

    Whole texts are scanned; a missing or empty text has no spans. ``known`` lists values that are no secrets; it is a
    bounded setting, not corpus data. Repeated rows are scanned one by one, other columns ignored, and an empty table
    gives an empty result.
    """

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        encoding = _encoding(ranks_path, pattern)
        for batch in batches:
            out: dict[str, list] = {name: [] for name in ("base_spans", "spans", *(f"n_{kind}" for kind in KINDS))}
            for value in batch["text"]:
                spans = find_spans((value or b"").decode(), encoding, chars_per_token, known)
                out["spans"].append(render(spans))
                out["base_spans"].append(render([span for span in spans if span[1] < 3]))
                for i, kind in enumerate(KINDS):
                    out[f"n_{kind}"].append(sum(span[1] == i for span in spans))
            yield {"key": batch["key"], **out}

    counts = ", ".join(f"n_{kind} long" for kind in KINDS)
    schema = f"key {df.schema[key].dataType.simpleString()}, {counts}, base_spans string, spans string"
    return map_rows(texts_of(df, key, text, valid=True), schema, task).withColumnRenamed("key", key)


def redact_secrets(
    df: DataFrame,
    ranks_path: str,
    pattern: str,
    text: str = "text",
    chars_per_token: float = CHARS_PER_TOKEN,
    known: frozenset[str] = frozenset(),
    mark: str = "[secret]",
) -> DataFrame:
    """``df`` with every span of its text replaced by ``mark`` (overlapping spans by one); missing text stays missing.

    Bytes that are no UTF-8 become the replacement character in every column of strings. Rows are masked one by one,
    repeated or not; an empty table gives an empty result; all columns are kept, whatever their names.
    """

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        encoding = _encoding(ranks_path, pattern)
        for batch in batches:
            out = []
            for value in batch[text]:
                if value is not None:
                    pieces, at = [], 0
                    for start, _, end in find_spans(value, encoding, chars_per_token, known):
                        if start >= at:
                            pieces += [value[at:start], mark]
                        at = max(at, end)
                    value = "".join([*pieces, value[at:]])
                out.append(value)
            yield {**batch, text: out}

    fields = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in df.schema)
    strings = [field.name for field in df.schema if field.dataType.typeName() == "string"]
    return map_rows(df.withColumns({name: F.make_valid_utf8(F.col(f"`{name}`")) for name in strings}), fields, task)


by_value(__name__)
