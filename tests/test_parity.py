from __future__ import annotations

import pytest

from tessera import registry
from tests.conftest import DATA
from tests.oracle import connected, same

SF = f"{DATA}/sf0.001"
SQL = registry.oracle_sql()
WITHOUT = sorted(set(registry.queries()) - set(SQL))


@pytest.fixture(scope="module")
def con():
    return connected(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_duckdb(spark, con, name):
    same(registry.queries()[name](spark, SF), con, SQL[name])


@pytest.mark.parametrize("name", WITHOUT)
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() >= 0


def test_every_name_has_a_query():
    assert set(SQL) <= set(registry.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
