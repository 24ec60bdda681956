"""Every registered query against its SQL, and the shape of its plan."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import connect, difference, table_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    row = entry(spark).first()
    assert (row["chi2"], row["p_value"], row["cramers_v"], row["min_expected"]) == (1.042437, 0.593797, 0.109462, 0.758621)


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    plan = _plan(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    got = table_of(df.columns, [tuple(row) for row in df.collect()])
    if name not in oracle_sql():
        assert got[1]
        return
    cursor = duck.execute(oracle_sql()[name])
    expected = table_of([column[0] for column in cursor.description], cursor.fetchall())
    assert difference(got, expected) is None


def test_limits_reach_the_scan(spark):
    plan = _plan(queries()["outlier_rows"](spark, SF))
    assert "PushedFilters: [IsNotNull(n_chars), Or(LessThan(n_chars" in plan or "PushedFilters: [Or(LessThan(n_chars" in plan


def test_narrow_scans(spark):
    plan = _plan(queries()["contingency_table"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan
    assert "text" not in plan


def test_no_window_over_a_whole_key(spark):
    assert "Window" not in _plan(queries()["group_count_broadcast"](spark, SF))
