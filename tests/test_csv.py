"""CSV with inferred types and bad lines; writes that keep the old table until the new one is whole."""

import random
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from tabscope.sources.tables import read_csv_checked, recover_table, write_table

KINDS = {"int64": "bigint", "float64": "double", "bool": "boolean", "object": "string", "str": "string", "string": "string"}


def test_types_equal_those_of_a_reader_of_the_whole_file(spark, tmp_path):
    rng = random.Random(2)
    forms = {
        "whole": lambda: str(rng.randrange(-50, 10**12)),
        "decimal": lambda: rng.choice(["1", "2.5", "-3e4", ".5", "7."]),
        "truth": lambda: rng.choice(["True", "false", "TRUE"]),
        "text": lambda: rng.choice(["a", "1", "true"]),
        "late": lambda: "4",
        "code": lambda: f"{rng.randrange(99):05d}",
        "huge": lambda: "123456789012345678901234567890",
        "endless": lambda: rng.choice(["inf", "-Infinity", "1"]),
        "mixed": lambda: rng.choice(["True", "1"]),
    }
    rows = [{name: make() for name, make in forms.items()} for _ in range(400)]
    rows[-1]["late"] = "4.5"  # the type is decided by the last row
    for part, chunk in enumerate((rows[:150], rows[150:])):
        pd.DataFrame(chunk).to_csv(tmp_path / f"{part}.csv", index=False, encoding="utf-8-sig")
    pd.DataFrame(rows).to_csv(tmp_path / "all.txt", index=False)
    whole = pd.read_csv(tmp_path / "all.txt")
    found = read_csv_checked(spark, [str(tmp_path / f"{part}.csv") for part in (0, 1)])
    assert dict(found.table.dtypes) == {name: KINDS[str(kind)] for name, kind in whole.dtypes.items()}
    assert found.rejected.count() == 0 and found.table.count() == 400
    assert sorted(r["whole"] for r in found.table.collect()) == sorted(whole["whole"].tolist())
    codes = read_csv_checked(spark, str(tmp_path / "0.csv"), keep_codes=True)
    assert dict(codes.table.dtypes)["code"] == "string"


def test_missing_values_and_empty_columns(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c,d\n1,NA,true,\n,,n/a,nan\n3,,False,null\n")
    found = read_csv_checked(spark, str(tmp_path / "t.csv"))
    assert found.table.dtypes == [("a", "bigint"), ("b", "double"), ("c", "boolean"), ("d", "double")]
    assert sorted(map(str, (tuple(r) for r in found.table.collect()))) == sorted(
        map(str, [(1, None, True, None), (None, None, None, None), (3, None, False, None)])
    )
    (tmp_path / "none.csv").write_text("a,b\n")
    empty = read_csv_checked(spark, str(tmp_path / "none.csv"))
    assert empty.table.columns == ["a", "b"] and empty.table.count() == empty.rejected.count() == 0


def test_bad_lines_are_kept(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('k,n\na,1\nb\nc,2,3\n"d ""q""",x\ne,1.5\nf,7\n')
    schema = StructType().add("k", StringType()).add("n", IntegerType())
    found = read_csv_checked(spark, str(path), schema)
    assert sorted(map(tuple, found.table.collect())) == [("a", 1), ("f", 7)] and found.table.dtypes[1] == ("n", "int")
    rejected = sorted((r["line"], r["column"], r["value"], r["reason"]) for r in found.rejected.collect())
    assert [r[1:] for r in rejected if r[1]] == [("n", "x", "not a int"), ("n", "1.5", "not a int")]
    assert [r[0] for r in rejected if not r[1]] == ["b", "c,2,3"]
    assert all(Path(r["file"]).name == "t.csv" for r in found.rejected.collect())
    inferred = read_csv_checked(spark, str(path))
    assert inferred.table.dtypes == [("k", "string"), ("n", "string")] and inferred.rejected.count() == 2
    with pytest.raises(ValueError, match="header"):
        read_csv_checked(spark, str(path), StructType().add("n", StringType()).add("k", StringType()))


def test_a_failed_overwrite_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(spark.range(5), path)
    bad = spark.range(9).repartition(3).withColumn("id", F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("no")).cast("long")))
    with pytest.raises(Exception, match="no"):
        write_table(bad, path)
    assert sorted(r[0] for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3, 4]
    assert [x.name for x in tmp_path.iterdir()] == ["t"]
    # A table may be written from itself.
    write_table(spark.read.parquet(path).where("id > 2"), path)
    assert sorted(r[0] for r in spark.read.parquet(path).collect()) == [3, 4]
    with pytest.raises(Exception, match="exists|EXISTS"):
        write_table(spark.range(1), path, mode="errorifexists")


def test_a_swap_that_was_cut_off_is_mended(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(spark.range(3), path)
    Path(path).rename(f"{path}.old-1")
    spark.range(7).write.parquet(f"{path}.new-1")
    assert recover_table(spark, path) and spark.read.parquet(path).count() == 3
    assert [x.name for x in tmp_path.iterdir()] == ["t"]
    assert recover_table(spark, path) and not recover_table(spark, str(tmp_path / "other"))


def test_marked_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, "b,c")], "id long, s string").repartition(2)
    path = write_table(df, str(tmp_path / "csv"), "csv", mark=True)
    files = list(Path(path).glob("*.csv"))
    assert files and all(file.read_bytes().startswith(b"\xef\xbb\xbfid") for file in files)
    assert pd.concat(pd.read_csv(file, encoding="utf-8-sig") for file in files)["s"].sort_values().tolist() == ["b,c", "é"]
    back = read_csv_checked(spark, path).table
    assert back.columns == ["id", "s"] and sorted(map(tuple, back.collect())) == [(1, "é"), (2, "b,c")]
