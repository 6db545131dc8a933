"""Registered queries against their SQL on the smallest data."""

import pytest

import __spark_entry__ as entry
from seawake.checks import registry
from seawake.checks.run import compare, connect
from tests.conftest import SF

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
NAMES = [n for n in QUERIES if n in registry.QUERIES]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 12


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
