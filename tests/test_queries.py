"""Every registered query against its SQL, and the shape of its plan."""

import pytest

from driftline.workload import ORACLES, QUERIES
from tests.compare import connect, difference, spark_rows, sql_rows


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    """Rows as in SQL; no pairwise join and no Python in the plan, nor in the plan that reads back what a job wrote."""
    df = QUERIES[name](spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan
    got = spark_rows(df)
    if name in ORACLES:
        assert difference(got, sql_rows(con, ORACLES[name])) is None


def test_filters_reach_the_scan(spark, data):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = QUERIES["b13_conditions_anded"](spark, data)._jdf.queryExecution().executedPlan().toString()
    for part in ("EqualTo(o_orderstatus,O)", "GreaterThan(o_totalprice,100000.0)", "StringContains(o_orderpriority,HIGH)"):
        assert part in plan
    assert "o_orderdate" not in plan.split("ReadSchema")[1]


def test_top_rows_are_cut_before_the_shuffle(spark, data):
    for name in ("e01_last_change_per_key", "e02_first_occurrence", "e03_newest_per_task", "a17_snapshot_merge"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan and "Partial" in plan


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
