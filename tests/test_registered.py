"""Every registered query against its SQL twin, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference
from tablewright.catalogue import all_queries, registry

all_queries.load()
# The training-data queries have tests of their own.
QUERIES = {name: fn for name, fn in entry.queries().items() if name in registry.QUERIES}
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    assert difference(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(registry.QUERIES) == set(registry.ORACLES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["product", "revenue"]
