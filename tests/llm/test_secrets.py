import random
import re
import string
import time

import public_tokenizers

from tabscope.llm import secrets
from tabscope.llm.queries import BYTE_RANKS
from tabscope.llm.secrets import redact_secrets, scan_secrets

RANKS, PATTERN = public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN


def brute(text):
    """The known forms as they are defined, each searched over the whole text."""
    text, spans = text or "", []
    words = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
    key = f"(?:{words}|[aA][pP][iI]_?[kK][eE][yY])"
    for kind, pattern, fits in (
        ("assign", key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 8),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    ):
        spans += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if fits(m)]
    order = ("assign", "access", "hex")
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda s: (s[0], order.index(s[1]))))


def pieces(seed):
    rng = random.Random(seed)
    parts = ["password", "TOKEN", "Api_Key", "apikey", "secret", ":", " = ", '"', "'", "=", "abc", "AKIA", "ABCDEFGH1234", "é", " ",
             "0123456789abcdef", "deadbeef" * 4, "\n", "-", "tokenſ", "K"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(40)))


def test_known_forms_match_brute_force(spark, messy, messy_rows, no_documents):
    texts = [pieces(seed) for seed in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = scan_secrets(df, RANKS, PATTERN).collect()
    for r in rows:
        assert r["base_spans"] == brute(texts[r["doc_id"]]), texts[r["doc_id"]]
        kept = [span for span in r["spans"].split(",") if span and not span.startswith("random")]
        assert ",".join(kept) == r["base_spans"]
        counts = [sum(span.startswith(kind) for span in kept) for kind in ("assign", "access", "hex")]
        assert counts == [r["n_assign"], r["n_access"], r["n_hex"]]
    assert len(rows) == 3000
    found = scan_secrets(messy, RANKS, PATTERN).collect()
    assert len(found) == len(messy_rows) and all(r["spans"] == "" for r in found)
    assert scan_secrets(no_documents, RANKS, PATTERN).collect() == []


def test_random_strings_by_token_efficiency(spark):
    rng = random.Random(5)
    secret = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n)) for n in (24, 32, 40, 64)]
    plain = [
        "internationalization2024", "some_long_variable_name_with_parts", "path/to/another/directory/file2",
        "123e4567-e89b-12d3-a456-426614174000", "9e107d9d372bb6826bd81d3542a419d6", "2024-01-01-2025-12-31-2026",
        "Donaudampfschiffahrtsgesellschaft", "12345678901234567890123456", "allowed" + secret[0],
    ]
    df = spark.createDataFrame(list(enumerate(f"see é {x} there" for x in [*secret, *plain])), "doc_id long, text string")
    known = frozenset([plain[-1]])
    found = {r["doc_id"]: r["spans"] for r in scan_secrets(df, RANKS, PATTERN, known=known).collect()}
    for i, x in enumerate(secret):
        assert found[i] == f"random:6:{6 + len(x)}"
    assert all("random" not in found[i] for i in range(len(secret), len(found)))
    masked = {r["doc_id"]: r["text"] for r in redact_secrets(df, RANKS, PATTERN, known=known).collect()}
    assert masked[0] == "see é [secret] there" and masked[len(secret)] == f"see é {plain[0]} there"


def test_random_strings_of_any_shape_and_behind_readable_parts(spark):
    rng = random.Random(8)

    def made(letters, n):
        return "".join(rng.choice(letters) for _ in range(n))

    key = made(string.ascii_letters + string.digits, 32)
    path = "international/documentation/directory/information/" * 4
    whole = [
        made(string.ascii_letters, 30), made(string.ascii_letters, 30) + "42", made(string.ascii_lowercase, 32),
        "-".join(made(string.ascii_uppercase, 5) for _ in range(5)), made(string.ascii_letters + string.digits, 18),
    ]
    behind = [path + key, "international_documentation_information_" * 4 + "=" + key, path + whole[3] + "/information"]
    plain = [path, "1999-12-31/2024-01-01", "=" * 40, "-_" * 20, "9e107d9d372bb6826bd81d3542a419d6", "internationalization"]
    texts = [f"see {x} there" for x in [*whole, *behind, *plain]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in scan_secrets(df, RANKS, PATTERN).collect()}
    for i, x in enumerate([*whole, key, key, whole[3]]):
        at = texts[i].index(x)
        assert found[i] == f"random:{at}:{at + len(x)}", texts[i]
    assert all("random" not in found[i] for i in range(len(whole) + len(behind), len(texts)))


def test_many_spans_take_time_in_proportion():
    encoding = secrets._encoding(RANKS, PATTERN)
    text = "password=hunter2hunter2 x\n" * 20_000
    begun = time.perf_counter()
    spans = secrets.find_spans(text, encoding, 2.2, frozenset())
    assert len(spans) == 20_000 and time.perf_counter() - begun < 15


def test_bounds_of_random_strings():
    """Runs are encoded in slices, and shorter strings than the least are not looked at: both as documented."""
    encoding = secrets._encoding(RANKS, PATTERN)
    rng = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def found(run):
        return [span for span in secrets.find_spans(f"see {run} there", encoding, 2.2, frozenset()) if span[1] == 3]

    runs = ["".join(rng.choice(letters) for _ in range(n)) for n in (16, 40, 700, 3000)]
    assert all(found(run) == [(4, 3, 4 + len(run))] for run in runs)
    assert not any(found(run[: secrets.LEAST_RANDOM - 1]) for run in runs)
    sliced = sum(len(encoding.encode_ordinary(runs[3][i : i + secrets.SLICE])) for i in range(0, 3000, secrets.SLICE))
    assert 0 <= sliced - len(encoding.encode_ordinary(runs[3])) <= 3000 // secrets.SLICE + 1
