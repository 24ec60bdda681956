"""License scans: word-bigram Dice against templates, with column expressions only."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_DICE = 0.8

# Short notices by which texts name their licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def normalized_words(text: Column) -> Column:
    """Lower-case runs of letters and digits of ASCII, as an array; empty for text without any."""
    plain = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    pairs = F.zip_with(
        F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b)
    )
    return F.when(F.size(words) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def template_bigrams(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def size_bounds(n: int, least_dice: float) -> tuple[int, int]:
    """Smallest and largest bigram set that can reach the coefficient with one of ``n``."""
    return math.ceil(n * least_dice / (2 - least_dice) - 1e-9), math.floor(n * (2 - least_dice) / least_dice + 1e-9)


def anchor_words(templates: Mapping[str, str], least_dice: float) -> list[str]:
    """Words of which every text that matches a template holds one.

    A match shares at least dice / (2 - dice) of the template's bigrams, so of any larger rest of them it shares one. The
    rest with the longest words is taken, and of each of its bigrams the longer word.
    """
    chosen = set()
    for text in templates.values():
        grams = sorted(template_bigrams(text), key=lambda gram: -max(map(len, gram.split())))
        rest = len(grams) - math.ceil(len(grams) * least_dice / (2 - least_dice) - 1e-9) + 1
        chosen |= {max(gram.split(), key=len) for gram in grams[:rest]}
    return sorted(chosen)


def scan_licenses(
    df: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    key: str = "doc_id",
    text: str = "text",
    least_dice: float = LEAST_DICE,
) -> DataFrame:
    """One row per matching segment and template: key, segment, license, n_bigrams, overlap and dice.

    Segments are the lines of a text (from 0), and the whole text (-1) if it has several lines. Dice is twice the shared
    word bigrams over the sum of both sets, rounded to 6 places. A segment is compared only with templates whose size
    allows ``least_dice``: each template is listed under every such size, and segments look up their own size. Texts
    without any anchor word are dropped before their words are cut, which loses no match. Whole texts are scanned.

    ``templates`` is a bounded setting sent to every task. Templates of less than two words match nothing; missing or
    empty texts have no match; ties are all reported, repeated rows one by one; other columns are ignored.
    """
    rows = []
    for name, notice in templates.items():
        grams = template_bigrams(notice)
        low, high = size_bounds(len(grams), least_dice)
        rows += [(size, name, grams) for size in range(max(low, 1), high + 1) if grams]
    listed = df.sparkSession.createDataFrame(rows, "size int, license string, grams array<string>")
    anchors = anchor_words(templates, least_dice)
    lower = F.lower("text")
    held = F.lit(False)
    for word in anchors:
        held = held | F.contains(lower, F.lit(word))
    lines = F.split("text", "\n")
    whole = F.struct(F.lit(-1).alias("segment"), F.col("text").alias("part"))
    parts = F.transform(lines, lambda line, i: F.struct(i.alias("segment"), line.alias("part")))
    segments = (
        df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
        .where(held)
        .select("key", F.explode(F.when(F.size(lines) > 1, F.array_append(parts, whole)).otherwise(parts)).alias("s"))
        .select("key", F.col("s.segment").cast("long").alias("segment"), bigrams(normalized_words(F.col("s.part"))).alias("own"))
        .withColumn("size", F.size("own"))
    )
    overlap = F.size(F.array_intersect("own", "grams"))
    compared = segments.join(F.broadcast(listed), "size").withColumn("overlap", overlap.cast("long"))
    dice = F.round(2.0 * F.col("overlap") / (F.col("size") + F.size("grams")), 6)
    return (
        compared.withColumn("dice", dice)
        .where(F.col("dice") >= least_dice)
        .select(F.col("key").alias(key), "segment", "license", F.col("size").cast("long").alias("n_bigrams"), "overlap", "dice")
    )
