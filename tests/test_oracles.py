"""Every engine query against DuckDB over the same tables."""

import pytest
from conftest import SF
from oracle import check, connection

from quartermark.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    check(QUERIES[name](spark, SF), SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0
