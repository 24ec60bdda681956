"""Sources, sinks, columns and joins."""

from pathlib import Path

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

from tabscope.operators.columns import (
    cast_columns,
    coalesce_constant,
    drop_rename,
    filter_observed,
    presence_flags,
    select_required,
    split_features_target,
)
from tabscope.operators.joins import enrich_left_join, group_count_broadcast, hot_keys, join_coverage
from tabscope.session import scratch_dir, stage, staging
from tabscope.sources.tables import (
    literal_dimension,
    read_csv_table,
    read_report_bundle,
    write_report_bundle,
    write_table,
)


def test_csv_quirks(spark, tmp_path):
    path = tmp_path / "t.csv"
    text = '﻿name,code,year,source\r\n"Roses",007,1990,"Idescat, cens"\r\nNA,08001,,"say ""hi"""\r\nnan,1,n/a,x\r\n'
    path.write_text(text, encoding="utf-8", newline="")
    schema = StructType().add("name", StringType()).add("code", StringType()).add("year", IntegerType()).add("source", StringType())
    rows = [tuple(row) for row in read_csv_table(spark, str(path), schema).collect()]
    assert rows == [("Roses", "007", 1990, "Idescat, cens"), (None, "08001", None, 'say "hi"'), (None, "1", None, "x")]
    wrong = StructType().add("name", StringType()).add("code", DoubleType()).add("year", IntegerType()).add("source", IntegerType())
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_csv_table(spark, str(path), wrong).collect()
    swapped = StructType().add("code", StringType()).add("name", StringType()).add("year", StringType()).add("source", StringType())
    with pytest.raises(Exception):
        read_csv_table(spark, str(path), swapped).collect()


def test_csv_round_trip_and_bundle(spark, tmp_path):
    df = literal_dimension(spark, [(1, "Masnou, el"), (2, None)], "id int, town string", {"year": 2025}, ("town", "key"), ["el", "la"])
    assert [row["key"] for row in df.orderBy("id").collect()] == ["el masnou", None]
    path = write_table(df, str(tmp_path / "csv"), "csv")
    assert sorted(map(tuple, read_csv_table(spark, path, df.schema).collect())) == sorted(map(tuple, df.collect()))
    paths = write_report_bundle({"a": df, "b": df.limit(1)}, str(tmp_path / "bundle"))
    back = read_report_bundle(spark, paths)
    assert back["a"].count() == 2 and back["b"].count() == 1
    with pytest.raises(ValueError):
        write_table(df, str(tmp_path / "x"), "xlsx")


def test_a_cluster_needs_a_shared_folder():
    def session(master, **conf):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, getConf=lambda: SimpleNamespace(contains=conf.__contains__))
        values = {"spark.sql.warehouse.dir": "file:/here/", **conf}
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default=None: values.get(name, default)))

    assert scratch_dir(session("local[2]")) == "file:/here"
    assert scratch_dir(session("spark://m", **{"spark.sql.warehouse.dir": "hdfs://w"})) == "hdfs://w"
    assert scratch_dir(session("yarn", **{"spark.checkpoint.dir": "hdfs://c/"})) == "hdfs://c"
    with pytest.raises(ValueError, match="share"):
        scratch_dir(session("yarn"))


def test_scratch_follows_the_session_setting(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert scratch_dir(spark) == folder
    staged = stage(spark.range(5), "numbers")
    assert staged.count() == 5 and any(Path(folder).rglob("*.parquet"))


def test_columns(spark):
    df = spark.createDataFrame([(1, None, 0), (2, 5.0, 0), (3, 7.0, 1)], "id int, x double, x_imputed int")
    with pytest.raises(ValueError, match=r"\['y', 'z'\]"):
        select_required(df, ["id", "y", "z"])
    assert drop_rename(df, ["x"], {"id": "key"}).columns == ["key", "x_imputed"]
    flags = presence_flags(df, {"has_x": "x"}, {"no_x": "x"}).orderBy("id").collect()
    assert [(row["has_x"], row["no_x"]) for row in flags] == [(0, 1), (1, 0), (1, 0)]
    assert [row["id"] for row in filter_observed(df, "x").collect()] == [2]
    assert filter_observed(df.drop("x_imputed"), "x").count() == 2
    assert coalesce_constant(df, {"x": -1.0}).agg(F.sum("x")).first()[0] == 11.0
    both = split_features_target(df.na.fill(0), ["x"], "x_imputed", ["id"])
    assert both.dtypes == [("id", "int"), ("x", "double"), ("x_imputed", "int")]
    spark.conf.set("spark.sql.ansi.enabled", "false")
    with pytest.raises(Exception, match="s does not fit int: a"):
        cast_columns(spark.createDataFrame([("a",)], "s string"), {"s": "int"}).collect()
    spark.conf.unset("spark.sql.ansi.enabled")


def _facts(spark):
    # Key "hot" holds a third of the rows, NULL another large share.
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 50))
    return spark.range(3000).withColumn("key", key)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_enrich_left_join(spark, limit):
    dim = spark.createDataFrame([("hot", 1.0), ("k1", 2.0), ("unused", 3.0), (None, 4.0)], "key string, v double")
    got = enrich_left_join(_facts(spark), dim, ["key"], "matched", "v", ["id"], broadcast_bytes=limit)
    assert got.columns == ["id", "key", "v", "matched"]
    rows = {row["id"]: row for row in got.collect()}
    assert len(rows) == 3000
    for i, row in rows.items():
        expected = {"hot": 1.0, "k1": 2.0}.get(row["key"])
        assert row["v"] == expected and row["matched"] == (expected is not None)
    plan = got._jdf.queryExecution().analyzed().toString()
    assert ("__salt" in plan) == (limit == 0) and ("broadcast" in plan) == (limit > 0)
    assert join_coverage(got, "matched").first()[0] == pytest.approx(sum(r["matched"] for r in rows.values()) / 30)


def test_enrich_refuses_repeated_keys(spark):
    dim = spark.createDataFrame([("a", 1), ("a", 2)], "key string, v int")
    with pytest.raises(ValueError, match="not unique"):
        enrich_left_join(_facts(spark), dim, ["key"])


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_group_count_broadcast(spark, limit):
    facts = _facts(spark).withColumn("name", F.when(F.col("id") % 7 != 0, F.lit("x")))
    got = group_count_broadcast(facts, ["key"], "name", "n", ["id"], broadcast_bytes=limit).collect()
    expected: dict = {}
    for row in got:
        expected[row["key"]] = expected.get(row["key"], 0) + (row["name"] is not None)
    assert len(got) == 3000 and all(row["n"] == expected[row["key"]] for row in got)
    assert None in expected


def test_hot_keys_are_found_and_cut(spark):
    hot, pieces = hot_keys(_facts(spark), ["key"])
    known = spark.createDataFrame([("hot",), (None,)], "key string").select(F.xxhash64("key")).collect()
    assert {row[0] for row in known} <= set(hot)
    assert 300 < pieces <= 1000
    assert hot_keys(spark.range(5000), ["id"]) == ([], 1)
    assert hot_keys(spark.range(0), ["id"]) == ([], 1)


def test_hot_rows_spread_by_all_columns(spark):
    facts = spark.range(20_000).select(F.lit(1).alias("same"), F.lit("hot").alias("key"), "id")
    dim = spark.createDataFrame([("hot", 1.0), ("k", 2.0)], "key string, v double")
    joined = enrich_left_join(facts, dim, ["key"], "matched", broadcast_bytes=0)
    assert joined.agg(F.sum("matched")).first()[0] == 20_000
    pieces = facts.select(F.pmod(F.xxhash64("same", "id"), F.lit(1000)).alias("piece")).groupBy("piece").count()
    assert pieces.agg(F.max("count")).first()[0] < 60
    assert "xxhash64(same" in joined._jdf.queryExecution().analyzed().toString()


def test_names_on_both_sides(spark):
    facts = spark.createDataFrame([(1, "a", 5)], "id int, key string, v int")
    dim = spark.createDataFrame([("a", 7)], "key string, v int")
    with pytest.raises(ValueError, match="both sides"):
        enrich_left_join(facts, dim, ["key"])
    row = enrich_left_join(facts, dim, ["key"], "found", "v", suffix="_dim").first()
    assert (row["v"], row["v_dim"], row["found"]) == (5, 7, 1)


def test_key_types_may_differ_only_among_numbers(spark):
    facts = spark.range(900).withColumn("key", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("int"))
    dim = spark.createDataFrame([(7, "hot"), (10**12, "far")], "key long, v string")
    got = enrich_left_join(facts, dim, ["key"], "matched", spread_by=["id"], broadcast_bytes=0)
    assert got.agg(F.sum("matched")).first()[0] == facts.where("key = 7").count()
    with pytest.raises(ValueError, match="key key is int"):
        enrich_left_join(facts, dim.withColumn("key", F.col("key").cast("string")), ["key"])


def test_staged_tables_go_with_their_block(spark):
    with staging(spark):
        table = stage(spark.range(3), "short-lived")
        path = table.inputFiles()[0].removeprefix("file://")
        assert table.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path)
