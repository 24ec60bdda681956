"""String columns: comparable name keys and code padding."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as blank at the ends of a name.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# ASCII characters that cannot be part of a key.
OTHER_ASCII = "".join(chr(code) for code in range(128) if not re.match("[a-z0-9 ]", chr(code)))


def _plain(text: str) -> str:
    """Compatibility-decomposed ASCII form; every character that cannot be part of a key becomes a space."""
    ascii_text = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii")
    return re.sub(r"[^a-z0-9]", " ", ascii_text)


@cache
def _fold_tables() -> tuple[str, str, tuple[tuple[str, str], ...], str]:
    """``translate`` arguments for all characters that fold to one, the characters that fold to more, and a pattern
    that finds the latter."""
    source, target, longer, codes = [], [], [], []
    for code in range(0x80, 0x20000):
        char = chr(code)
        if 0xD800 <= code <= 0xDFFF:
            continue
        plain = _plain(char)
        if not plain:
            continue
        if len(plain) == 1 or not plain.strip():
            source.append(char)
            target.append(plain[0])
        else:
            longer.append((char, plain))
            codes.append(code)
    starts = [code for code in codes if code - 1 not in set(codes)]
    ends = [code for code in codes if code + 1 not in set(codes)]
    ranges = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends))
    return "".join(source), "".join(target), tuple(longer), f"[{ranges}]"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once however often the body mentions it."""
    return F.transform(F.array(value), body).getItem(0)


def _article_first(name: Column, articles: Sequence[str]) -> Column:
    if not articles:
        return name
    choice = "|".join(re.escape(article) for article in articles)
    moved = F.regexp_replace(name, rf"(?diU)^(.*),\s*({choice})$", "$2 $1")
    longest = max(map(len, articles))
    return F.when(F.lower(F.right(name, F.lit(longest))).rlike(f"({choice})$"), moved).otherwise(name)


def _fold(text: Column) -> Column:
    """Accents off and other letters dropped; ASCII texts pass, and single characters are spelled out only where needed."""
    source, target, longer, pattern = _fold_tables()
    spelling = F.create_map(*[F.lit(part) for pair in longer for part in pair])
    spelled = F.array_join(
        F.transform(
            F.split(text, ""), lambda char: F.when(char.rlike(pattern), F.try_element_at(spelling, char)).otherwise(char)
        ),
        "",
    )
    letters = F.translate(F.when(text.rlike(pattern), spelled).otherwise(text), source, target)
    folded = F.regexp_replace(letters, r"[^\x00-\x7F]+", "")
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(folded)


def normalize_key(name: Column, articles: Sequence[str] = ()) -> Column:
    """Comparable form of a name: lower case, no accents, compatibility characters spelled out, single spaces.

    NULL stays NULL. ``articles`` are words that may trail a name after a comma and are moved to its front; one that
    ends in an apostrophe is also set apart from the word behind it. Everything stays inside Catalyst.
    """
    key = F.lower(_article_first(F.btrim(name, F.lit(BLANKS)), articles))
    for article in articles:
        if article.endswith("'"):
            word = article[:-1]
            key = F.replace(F.replace(key, F.lit(f"{article} "), F.lit(f"{word} ")), F.lit(article), F.lit(f"{word} "))
    key = _bound(key, _fold)
    return F.trim(F.regexp_replace(F.translate(key, OTHER_ASCII, " " * len(OTHER_ASCII)), " {2,}", " "))


def zero_pad_code(code: Column, width: int = 5) -> Column:
    """Left-pad with zeros to ``width``; longer codes are kept whole and a leading sign stays in front."""
    text = code.cast("string")
    return (
        F.when(F.length(text) >= width, text)
        .when(text.rlike("^[+-]"), F.concat(F.substring(text, 1, 1), F.lpad(F.substring(text, 2, width), width - 1, "0")))
        .otherwise(F.lpad(text, width, "0"))
    )


def key_digest(column: Column, longest: int = 64) -> Column:
    """Short stand-in for a text used only as a grouping key: long texts become a marked SHA-256.

    Keeps shuffles of whole documents narrow. Short texts are kept as they are, and a digest is one character
    longer than any kept text, so the two cannot meet.
    """
    digest = F.concat(F.lit("#"), F.sha2(column, 256))
    return F.when(F.length(column) > longest, digest).otherwise(column)
