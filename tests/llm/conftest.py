import random

import public_tokenizers
import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
# Extra columns whose names the operators use inside.
CLASHING = {"key": "k", "node": 1, "tokens": "t", "length": 7, "label": "x", "n": 3, "sequence_id": 9, "word": "w"}
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def tokenizer_path():
    return public_tokenizers.path("word_bpe_49k.json")


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="session")
def messy_rows():
    """Null and empty texts, white space, ties, copies, repeated rows and one very long text."""
    long = prose(99, 30_000)
    return [
        (1, None, "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, " \t\n\r ", None, None, None),
        (4, prose(4, 80), "en", "a", 1),
        (5, prose(4, 80), "en", "b", 1),
        (5, prose(4, 80), "en", "b", 1),
        (6, "one two three", "en", "b", 1),
        (7, "One TWO\tthree", "fr", "b", 1),
        (8, "é" * 5000, "fr", "c", 5000),
        (9, long, "en", "c", len(long)),
        (10, long + " and more", "en", "c", len(long)),
        (None, "no key at all", "en", "c", 13),
        (11, "漢字 текст \x1c mixed\x85script", "en", "c", 1),
    ]


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(messy_rows, DOCUMENTS)
    return docs.withColumns({name: F.lit(value) for name, value in CLASHING.items()})


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)
