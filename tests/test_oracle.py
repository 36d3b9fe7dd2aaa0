"""Every registered query that has a SQL twin agrees with it; the others run."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry
from tillwise.plans import registry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_twins_belong_to_queries():
    assert set(ORACLE) <= set(QUERIES)
    assert set(registry.QUERIES) - set(registry.ORACLE) == {"match_products"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, sf_dir, con, name):
    assert compare(QUERIES[name](spark, sf_dir), con, ORACLE[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
