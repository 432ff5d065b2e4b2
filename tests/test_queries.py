"""Every core query against its SQL on the smallest tables; those without SQL must run."""

import pytest

from lorekeep.plans.registry import core_queries, core_sql
from tests.sqlcheck import assert_same, connect

QUERIES, SQL = core_queries(), core_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, data, con):
    assert_same(QUERIES[name](spark, data), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, data):
    n = QUERIES[name](spark, data).count()
    assert n > 0 or name == "ppr_topk"  # the smallest tables have no fiftieth entity


def test_entry_has_core_queries(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0
