"""Every registered query against its SQL twin, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from oracle import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert ok is not False, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
