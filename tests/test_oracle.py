"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from checks import oracle, queries
from checks.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


def test_every_query_has_sql():
    assert set(queries.queries()) == set(oracle.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, connection, name):
    assert difference(queries.queries()[name](spark, SF), connection, oracle.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
