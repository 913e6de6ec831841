"""Every query against its SQL counterpart, and what its plan may contain."""

import pytest
from __spark_entry__ import entry, oracle_sql, queries
from compare import connect, difference
from quotewright.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.01"
ORACLE = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) <= set(ORACLE) & set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # rows are not multiplied, not sent to Python, and no group is ever gathered in one task
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas", "collect_list"):
        assert node not in plan
    windows = [line for line in plan.splitlines() if "Window " in line and "windowspecdefinition" in line]
    assert all("_part" in line for line in windows), windows
    assert difference(df, con, ORACLE[name]) is None


def test_entry(spark):
    assert entry(spark).count() > 0
