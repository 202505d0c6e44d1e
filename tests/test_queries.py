"""Every registered query with SQL gives DuckDB's rows; the rest run and give rows."""

from __future__ import annotations

import pytest

from keelson.plans import all_oracles, all_queries
from tests.compare import SF, connect, same


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_matches_sql(spark, con, name):
    same(all_queries()[name](spark, SF), con, all_oracles()[name])


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_oracles())))
def test_runs(spark, name):
    assert all_queries()[name](spark, SF).count() > 0


def test_entry_imports():
    import __spark_entry__

    assert set(all_queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
