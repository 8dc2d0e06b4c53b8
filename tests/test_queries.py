"""Every query with a SQL twin gives the twin's rows; plans hold no pairing of everything with everything."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, con, folder, name):
    got = entry.queries()[name](spark, folder)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert difference(got.toPandas(), con.execute(SQL[name]).df()) is None
    spark.catalog.clearCache()


def test_entry(spark):
    assert entry.entry(spark).count() == 2
