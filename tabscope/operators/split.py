"""Seeded train/test splits that depend on row keys only, so they are the same on every run and layout."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscope.operators.columns import require_columns
from tabscope.operators.joins import lookup_join, measured_bytes
from tabscope.operators.ranks import placed
from tabscope.session import stage

TRAIN, TEST = "train", "test"
# Digits of a digest, and those that a pass looks further.
DIGEST_DIGITS, PREFIX_DIGITS = 32, 3
# Rows of one class that are ranked in one task, and classes whose remainders are.
LISTED = 16_384


def _digest(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"_{seed}")))


def hash_split(df: DataFrame, key: str, test_size: float = 0.3, seed: int = 42, name: str = "split") -> DataFrame:
    """Label each row train or test by the digest of its unique key: no shuffle, shares hold in expectation."""
    require_columns(df, [key])
    cut = f"{math.floor(test_size * 16**8):08x}"
    part = F.when(F.substring(_digest(key, seed), 1, 8) < cut, F.lit(TEST)).otherwise(F.lit(TRAIN))
    return df.withColumn(name, part)


def class_quotas(df: DataFrame, target: str, test_size: float) -> DataFrame:
    """(target, n, n_test): proportional, whole numbers, largest remainders first, ceil(rows * test_size) in all.

    One row per class from here on; ties of the remainder go to the smaller class.
    """
    counts = stage(df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("n")), "class-counts")
    few = counts.count() <= LISTED
    total = F.sum("n").over(Window.partitionBy()) if few else F.lit(counts.agg(F.sum("n")).first()[0])
    n_train = total - F.ceil(total * F.lit(test_size))
    shares = counts.withColumn("n_train", n_train).withColumn("share", F.col("n") / total * F.col("n_train"))
    whole = shares.withColumn("whole", F.floor("share"))
    order = [F.desc(F.col("share") - F.col("whole")), F.col(target).asc()]
    if few:
        spare = F.col("n_train") - F.sum("whole").over(Window.partitionBy())
        ranked = whole.withColumn("__place", F.row_number().over(Window.orderBy(*order)))
    else:
        spare = F.col("n_train") - F.lit(whole.agg(F.sum("whole")).first()[0])
        ranked = placed(whole, order, "__place", 1)
    train = F.col("whole") + (F.col("__place") <= spare).cast("long")
    return ranked.withColumn("n_test", F.col("n") - train).select(target, "n", "n_test")


def digest_cuts(df: DataFrame, target: str, key: str, quotas: DataFrame, seed: int) -> DataFrame:
    """(target, cut): the digest at the quota rank of each class; classes with a quota of 0 are left out.

    Each pass counts, by class and a few more of their first digits, the digests that begin like the one that is looked
    for; running counts over at most 4096 cells a class name the cell that holds the rank. Passes go on until that cell
    is small in every class, and only its rows are ranked.
    """
    rows = df.where(F.col(target).isNotNull()).select(F.col(target).alias("__class"), _digest(key, seed).alias("digest"))
    digits = 0
    size = 2 * measured_bytes(quotas)  # a cell and a rank for each class are no longer
    edge = quotas.where("n_test > 0").select(F.col(target).alias("__class"), F.col("n_test").alias("rank"))
    while True:
        inside = _beginning(rows, edge, digits, size).drop("rank") if digits else rows
        digits += PREFIX_DIGITS
        cells = inside.groupBy("__class", F.substring("digest", 1, digits).alias("cell")).agg(F.count("*").alias("rows"))
        running = Window.partitionBy("__class").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        found = cells.withColumn("before", F.coalesce(F.sum("rows").over(running), F.lit(0)))
        found = lookup_join(found, edge.select("__class", "rank"), ["__class"], size)
        rank = F.col("rank") - F.col("before")
        edge = stage(found.where(rank.between(1, F.col("rows"))).select("__class", "cell", "rows", rank.alias("rank")), "edges")
        if digits >= DIGEST_DIGITS or (edge.agg(F.max("rows")).first()[0] or 0) <= LISTED:
            break
    order = Window.partitionBy("__class").orderBy("digest")
    ranked = _beginning(rows, edge, digits, size).withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") == F.col("rank")).select(F.col("__class").alias(target), F.col("digest").alias("__cut"))


def _beginning(rows: DataFrame, edge: DataFrame, digits: int, size: int) -> DataFrame:
    """Rows whose digest begins with the cell of their class, with the rank that is looked for there."""
    found = lookup_join(rows, edge.select("__class", "cell", "rank"), ["__class"], size, spread_by=["digest"])
    inside = found.where(F.substring("digest", 1, digits) == F.col("cell"))
    return inside.drop("cell")


def stratified_split(
    df: DataFrame, target: str, key: str, test_size: float = 0.3, seed: int = 42, name: str = "split"
) -> DataFrame:
    """Split with the exact quota of every class: the rows with the smallest digests of their class are test rows.

    Instead of ranking each class in one task, the digest at the quota rank is found by prefix counts and rows are
    compared with it. Any number of classes will do: their cuts are a table that is looked up, by broadcast within its
    measured size and else by shuffle. ``key`` must be unique; a row without target stays out of both parts.
    """
    require_columns(df, [target, key])
    quotas = stage(class_quotas(df, target, test_size), "quotas")
    cuts = stage(digest_cuts(df, target, key, quotas, seed), "cuts")
    found = lookup_join(df, cuts, [target], measured_bytes(cuts))
    part = F.when(_digest(key, seed) <= F.col("__cut"), F.lit(TEST)).otherwise(F.lit(TRAIN))
    return found.withColumn(name, F.when(F.col(target).isNotNull(), part)).drop("__cut")


def split_summary(df: DataFrame, target: str, name: str = "split") -> DataFrame:
    """Rows, positives and negatives per part."""
    return df.where(F.col(name).isNotNull()).groupBy(name).agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col(target) == 1).alias("n_positive"),
        F.count_if(F.col(target) == 0).alias("n_negative"),
    )


def parts(df: DataFrame, name: str = "split") -> tuple[DataFrame, DataFrame]:
    """(train rows, test rows)."""
    return tuple(df.where(F.col(name) == part).drop(name) for part in (TRAIN, TEST))
