from pyspark.sql import functions as F

from tabscope.operators.ranks import placed


def test_places_follow_the_order(spark):
    values = [f"k{i * 7919 % 5000:05d}é" for i in range(5000)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(9)
    rows = placed(df, [F.col("v").asc_nulls_last()], "at", 1).collect()
    want = {v: i for i, v in enumerate([*sorted(v for v in values if v is not None), None], 1)}
    assert {row["v"]: row["at"] for row in rows} == want
    assert len(rows) == 5001


def test_an_empty_table_has_no_places(spark):
    found = placed(spark.createDataFrame([], "v string"), [F.col("v")])
    assert found.columns == ["v", "place"] and found.collect() == []
