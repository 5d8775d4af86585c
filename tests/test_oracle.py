"""Every query that has SQL gives the same rows as that SQL on the smallest tables."""

import pytest

from compare import compare, connect
from plaintscope import catalog

catalog.load_all()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, small, con, name):
    assert compare(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], small) == []


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())
