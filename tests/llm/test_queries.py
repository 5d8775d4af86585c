"""Every query of the subpackage beside its SQL."""

import pytest

from compare import compare, connect
from plaintscope.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, small, name):
    assert compare(spark, connect(small), queries.QUERIES[name], queries.ORACLES[name], small) == []


@pytest.mark.parametrize("n", range(1, 14))
def test_every_operator_has_its_query(n):
    assert sum(q.startswith(f"op{n}_") for q in queries.QUERIES) == 1
