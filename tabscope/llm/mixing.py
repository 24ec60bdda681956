"""Mixing sources to target weights: capped targets, repetition rates, whole copies and one hash-seeded draw."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import by_value, staged
from tabscope.operators.joins import lookup_join, measured_bytes
from tabscope.operators.ranks import placed

WORD = r"[^\x20\x09-\x0D]+"
# Draws have so many steps: three hexadecimal digits of a digest.
STEPS = 4096
# Documents of one size class have sizes between two powers of two; no text has more words than this class holds.
CLASSES = 48


def draw(key: Column, text: Column, seed: int) -> Column:
    """The draw of a document in 0 .. STEPS - 1, from the digest of the seed, its key and its text."""
    parts = [F.coalesce(key.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def cycled_weights(sizes: DataFrame, cycle: Sequence[float], source: str = "source") -> DataFrame:
    """``sizes`` with a ``weight``: the cycle repeated over the sources by code point, NULL last."""
    ranked = placed(sizes, [F.col(source).asc_nulls_last()], "__place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("__place") % len(cycle) + 1).cast("int"))
    return ranked.withColumn("weight", weight).drop("__place")


def capped_targets(sizes: DataFrame, share: float, cap: float) -> DataFrame:
    """``sizes`` (source_size, weight) with a ``target`` each: ``share`` of all sizes in proportion to the weights.

    No target is above ``cap`` times its source's size; what is cut there goes to the others by weight, until none is
    above. With a common level x the targets are min(cap * size, x * weight): x is raised from the level that cuts
    nothing, and each round, one aggregate over the sources, cuts at least one more of them. Weights are above 0.
    """
    limit, size, weight = F.lit(cap) * F.col("source_size"), F.col("source_size"), F.col("weight")
    level = -1.0
    while True:
        free = limit > F.lit(level) * weight
        row = sizes.agg(
            F.sum(size).alias("all"),
            F.sum(F.when(~free, size).otherwise(0)).alias("cut"),
            F.sum(F.when(free, weight).otherwise(0.0)).alias("weights"),
        ).first()
        if not row["weights"]:
            break
        raised = (share * row["all"] - cap * row["cut"]) / row["weights"]
        if raised <= level:
            break
        level = raised
    return sizes.withColumn("target", F.least(limit, F.lit(max(level, 0.0)) * weight))


def _thresholds(cells: dict, extra: float, size: int) -> list[int]:
    """Per size class the steps of the draw that are taken, the largest class first.

    Each class is drawn with the fraction that the source still owes: what is left of ``extra`` over the words of this
    and all smaller classes. Over the draws its mean is the fraction of the whole source, for every document; what
    chance adds or leaves out among long documents is made up among shorter ones.
    """
    steps, owed, rest = [0] * CLASSES, extra, size
    for at in sorted(cells, reverse=True):
        fraction = min(max(owed / rest, 0.0), 1.0) if rest > 0 else 0.0
        steps[at] = int(math.floor(fraction * STEPS + 0.5))
        owed -= sum(words for step, words in cells[at] if step < steps[at])
        rest -= sum(words for _, words in cells[at])
    return steps


def mixing_rates(df: DataFrame, weights, share: float, cap: float, source: str, measured: dict[str, Column]) -> DataFrame:
    """One row per source: source_size, target, whole (copies of every document), steps (of one more, by class)."""
    cells = df.select(F.col(f"`{source}`").alias("source"), *[value.alias(name) for name, value in measured.items()])
    cells = staged(cells.groupBy("source", "cls", "step").agg(F.sum("size").cast("long").alias("words")), "mix-cells")
    sizes = staged(weights(cells.groupBy("source").agg(F.sum("words").cast("long").alias("source_size"))), "mix-sizes")
    targets = staged(capped_targets(sizes, share, cap), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("whole", F.floor(rate).cast("int"))
    per_source = lookup_join(cells, targets.drop("weight"), ["source"], measured_bytes(targets), null_safe=True)

    def walk(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        classes: dict[int, list] = {}
        for at, step, words in zip(own["cls"], own["step"], own["words"]):
            classes.setdefault(int(at), []).append((int(step), int(words)))
        size, whole = int(own["source_size"].iloc[0]), int(own["whole"].iloc[0])
        steps = _thresholds(classes, float(own["target"].iloc[0]) - whole * size, size)
        return pd.DataFrame({"source": [key[0]], "steps": [steps]})

    kind = cells.schema["source"].dataType.simpleString()
    steps = per_source.groupBy("source").applyInPandas(walk, f"source {kind}, steps array<int>")
    rates = staged(steps.withColumnRenamed("source", "__s"), "mix-steps")
    joined = targets.join(rates, F.col("source").eqNullSafe(F.col("__s")))
    return joined.select("source", "source_size", "target", "whole", "steps")


def mix_copies(
    df: DataFrame,
    cycle: Sequence[float],
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 42,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Every row of ``df`` with mix_size (words), mix_source_size, mix_target and mix_copies, its number of copies.

    A source's rate is its target over its size. Each document is copied floor(rate) times, and once more if its draw, a
    digest of the seed, its key and its text, falls below the fraction; see ``_thresholds``. Reruns agree, whatever the
    partitions. Rows equal in key and text share their draw; a missing text has no words; documents without words
    follow the fraction of the shortest class; NULL is a source of its own, the last; a source without words has no
    copies; an empty table gives no rows. Other columns are kept, and need names other than those that are added or begin
    with ``__mix_``.

    Words are counted per source, class and step of the draw, combined map-side, so a source with a third of all rows
    is at most CLASSES * STEPS cells. Rates go to every task within 64 MB, else rows of hot sources are spread.
    """
    if clash := {"mix_size", "mix_source_size", "mix_target", "mix_copies"} & set(df.columns):
        raise ValueError(f"columns of the result already exist: {sorted(clash)}")
    body = F.col(f"`{text}`")
    size = F.coalesce(F.regexp_count(body, F.lit(WORD)), F.lit(0)).cast("long")
    cls = F.when(size > 0, F.length(F.bin(size)) - 1).otherwise(0).cast("int")
    measured = {"size": size, "cls": cls, "step": draw(F.col(f"`{key}`"), body, seed)}
    rates = mixing_rates(df, lambda sizes: cycled_weights(sizes, cycle), share, cap, source, measured)
    rates = staged(rates.withColumnsRenamed({name: f"__mix_{name}" for name in rates.columns}), "mix-rates")
    own = {f"__mix_{name}": value for name, value in measured.items()} | {"__mix_source": F.col(f"`{source}`")}
    rows = lookup_join(df.withColumns(own), rates, ["__mix_source"], measured_bytes(rates), null_safe=True)
    own_steps = F.element_at("__mix_steps", F.col("__mix_cls") + 1)
    taken = (F.col("__mix_source_size") > 0) & (F.col("__mix_step") < own_steps)
    return rows.select(
        *[F.col(f"`{name}`") for name in df.columns],
        F.col("__mix_size").alias("mix_size"),
        F.col("__mix_source_size").alias("mix_source_size"),
        F.col("__mix_target").alias("mix_target"),
        (F.col("__mix_whole") + taken.cast("int")).alias("mix_copies"),
    )


def mix_sources(df: DataFrame, cycle: Sequence[float], **settings) -> DataFrame:
    """The mix itself: every row of ``df`` as often as ``mix_copies`` says, with its own columns."""
    counted = mix_copies(df, cycle, **settings).where("mix_copies > 0")
    copies = counted.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    return copies.select(*[F.col(f"`{name}`") for name in df.columns])


by_value(__name__)
