"""Feature encoding: fitted once on one table, applied as column expressions and level lookups to any table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.operators.columns import require_columns
from tabscope.operators.joins import lookup_join
from tabscope.operators.profile import levels_long
from tabscope.operators.ranks import placed

# Levels that wide results, with one column for each, may have; long results have no such bound.
MOST_COLUMNS = 10_000


@dataclass(frozen=True)
class LevelIndex:
    """The levels of categorical columns as a table: variable, level, and its place in the order of its variable.

    The driver holds the number of levels of each variable and their bytes, never the levels.
    """

    table: DataFrame | None
    sizes: Mapping[str, int]
    bytes: Mapping[str, int]

    def of(self, name: str) -> DataFrame:
        """(level, place) of one variable."""
        return self.table.where(F.col("variable") == name).select("level", "place")

    def without_first(self) -> LevelIndex:
        """The index without the first level of each variable."""
        if self.table is None:
            return self
        table = self.table.where("place > 0").withColumn("place", F.col("place") - 1)
        return LevelIndex(table, {name: max(n - 1, 0) for name, n in self.sizes.items()}, self.bytes)

    def listed(self) -> dict[str, list[str]]:
        """The levels themselves, for results that have a column for each."""
        found: dict[str, list[str]] = {name: [] for name in self.sizes}
        if sum(self.sizes.values()) > MOST_COLUMNS:
            raise ValueError(f"{sum(self.sizes.values())} levels are too many columns; the long results have no bound")
        for row in self.table.orderBy("place").collect() if self.table is not None else ():
            found[row["variable"]].append(row["level"])
        return found


def level_index(df: DataFrame, categorical: Sequence[str]) -> LevelIndex:
    """The sorted levels of each categorical, written as a table: distinct values, dealt by ranges, with places.

    One shuffle of the distinct values and one by their order; a hot level is one row after the map side.
    """
    require_columns(df, categorical)
    if not categorical:
        return LevelIndex(None, {}, {})
    distinct = levels_long(df, categorical).distinct()
    table = placed(distinct, [F.col("variable"), F.col("value")])
    width = F.octet_length("value") + 16
    rows = table.groupBy("variable").agg(F.min("place").alias("first"), F.count("*").alias("n"), F.sum(width).alias("bytes"))
    found = {row["variable"]: row for row in rows.collect()}
    first = F.create_map(*[F.lit(x) for name, row in found.items() for x in (name, row["first"])]) if found else F.lit(None)
    place = F.col("place") - F.element_at(first, F.col("variable")) if found else F.col("place")
    table = table.select("variable", F.col("value").alias("level"), place.alias("place"))
    sizes = {name: found[name]["n"] if name in found else 0 for name in categorical}
    return LevelIndex(table, sizes, {name: found[name]["bytes"] if name in found else 0 for name in categorical})


def given_levels(spark: SparkSession, levels: Mapping[str, Sequence[str]]) -> LevelIndex:
    """An index of listed levels."""
    rows = [(name, level, place) for name, own in levels.items() for place, level in enumerate(own)]
    table = spark.createDataFrame(rows, "variable string, level string, place long")
    sizes = {name: len(own) for name, own in levels.items()}
    return LevelIndex(table, sizes, {name: sum(len(level.encode()) + 16 for level in own) for name, own in levels.items()})


@dataclass(frozen=True)
class FeatureEncoder:
    """Standardised numerics, 0/1 columns as they are, one 0/1 feature per category level.

    Rows look their level up in the index and become sparse vectors, whatever the number of levels.
    """

    numeric: tuple[tuple[str, float, float], ...]
    binary: tuple[str, ...]
    levels: LevelIndex = field(default_factory=lambda: LevelIndex(None, {}, {}))

    def scaled(self) -> dict[str, Column]:
        """Output name -> expression of the numeric and 0/1 features."""
        out: dict[str, Column] = {}
        for name, mean, scale in self.numeric:
            out[f"num__{name}"] = (F.col(name).cast("double") - F.lit(mean)) / F.lit(scale)
        for name in self.binary:
            out[f"bin__{name}"] = F.col(name).cast("double")
        return out

    def flags(self) -> dict[str, Column]:
        """Output name -> 0/1 expression per level: for wide tables, which have a column for each by definition."""
        return {
            f"cat__{name}_{level}": F.coalesce(F.col(name).cast("string") == level, F.lit(False)).cast("double")
            for name, levels in self.levels.listed().items()
            for level in levels
        }

    def offsets(self) -> dict[str, int]:
        """Position of the first level of each categorical in the vector."""
        out, at = {}, len(self.numeric) + len(self.binary)
        for name, n in self.levels.sizes.items():
            out[name], at = at, at + n
        return out

    @property
    def width(self) -> int:
        return len(self.numeric) + len(self.binary) + sum(self.levels.sizes.values())

    @property
    def names(self) -> list[str]:
        """Feature names in matrix order, for wide tables; ``feature_names`` gives them as a table."""
        return [*self.scaled(), *[f"cat__{name}_{x}" for name, levels in self.levels.listed().items() for x in levels]]

    def flat(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` columns plus one column per feature."""
        features = {**self.scaled(), **self.flags()}
        return df.select(*keep, *[value.alias(name) for name, value in features.items()])

    def assemble(self, df: DataFrame, keep: Sequence[str] = (), output: str = "features") -> DataFrame:
        """``keep`` columns plus one sparse vector column. An unknown or missing level is all zeros.

        Levels are looked up by broadcast within 64 MB, else by a shuffle that spreads hot levels.
        """
        plain = {f"__f{i}": value for i, value in enumerate(self.scaled().values())}
        sizes = [(name, n) for name, n in self.levels.sizes.items() if n]
        texts = {f"__c{i}": F.col(name).cast("string") for i, (name, _) in enumerate(sizes)}
        rows = df.select(*keep, *[value.alias(slot) for slot, value in {**plain, **texts}.items()])
        indexed, vectors = [f"__i{i}" for i in range(len(sizes))], [f"__v{i}" for i in range(len(sizes))]
        if sizes:
            for (name, n), text, place in zip(sizes, texts, indexed):
                known = self.levels.of(name).select(F.col("level").alias(text), F.col("place").alias(place))
                rows = lookup_join(rows, known, [text], self.levels.bytes[name])
                rows = rows.withColumn(place, F.coalesce(place, F.lit(n)).cast("double"))
            # The place behind the last level stands for all others, and the encoder leaves it out.
            behind = df.sparkSession.createDataFrame([tuple(float(n) for _, n in sizes)], ", ".join(f"{x} double" for x in indexed))
            rows = OneHotEncoder(inputCols=indexed, outputCols=vectors, dropLast=True).fit(behind).transform(rows)
        assembler = VectorAssembler(inputCols=[*plain, *vectors], outputCol=output)
        return assembler.transform(rows).drop(*plain, *texts, *indexed, *vectors)


def fit_encoder(
    df: DataFrame,
    numeric: Sequence[str] = (),
    binary: Sequence[str] = (),
    categorical: Sequence[str] = (),
    drop_first: bool = False,
    levels: LevelIndex | Mapping[str, Sequence[str]] | None = None,
) -> FeatureEncoder:
    """Learn means, population deviations and levels.

    ``levels`` may come from a larger table than ``df``, so that a level absent from the training part keeps its
    column. ``drop_first`` leaves out the alphabetically first level of each categorical. A constant numeric is
    only centred.
    """
    require_columns(df, [*numeric, *binary, *categorical])
    learned: list[tuple[str, float, float]] = []
    if numeric:
        aggregates = []
        for i, name in enumerate(numeric):
            value = F.col(name).cast("double")
            aggregates += [F.avg(value).alias(f"m{i}"), F.stddev_pop(value).alias(f"s{i}")]
        row = df.agg(*aggregates).first()
        for i, name in enumerate(numeric):
            learned.append((name, row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0))
    if levels is None:
        levels = level_index(df, categorical)
    elif not isinstance(levels, LevelIndex):
        levels = given_levels(df.sparkSession, {name: levels[name] for name in categorical})
    return FeatureEncoder(tuple(learned), tuple(binary), levels.without_first() if drop_first else levels)


def standardize(df: DataFrame, columns: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Add (x - mean) / population deviation of each column."""
    encoder = fit_encoder(df, numeric=columns)
    scaled = encoder.scaled()
    return df.withColumns({f"{name}{suffix}": scaled[f"num__{name}"] for name in columns})


def one_hot(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), drop_first: bool = False) -> DataFrame:
    """One 0/1 column per sorted level (without the first one when ``drop_first``)."""
    encoder = fit_encoder(df, categorical=columns, drop_first=drop_first)
    flags = {name.removeprefix("cat__"): value.cast("int") for name, value in encoder.flags().items()}
    return df.select(*keep, *[value.alias(name) for name, value in flags.items()])


def feature_names(spark: SparkSession, encoder: FeatureEncoder) -> DataFrame:
    """The names of the encoded features with their positions in the matrix."""
    names = spark.createDataFrame(list(enumerate(encoder.scaled())), "position int, feature string")
    offsets = encoder.offsets()
    if encoder.levels.table is None or not offsets:
        return names
    first = F.element_at(F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair]), F.col("variable"))
    feature = F.concat(F.lit("cat__"), "variable", F.lit("_"), "level")
    return names.unionByName(
        encoder.levels.table.select((first + F.col("place")).cast("int").alias("position"), feature.alias("feature"))
    )
