"""Every registered query runs on the smallest tables; found cases agree with SQL or brute force."""

import pytest

from lorekeep.llm.queries import QUERIES, SQL
from tests.sqlcheck import assert_same, connect


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, data):
    assert_same(QUERIES[name](spark, data), connect(data), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, data):
    assert QUERIES[name](spark, data).count() > 0


def test_entry_registers_them():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
