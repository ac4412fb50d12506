"""Operators that SQL can express, against it."""

import pytest
from mendlake.llm import queries
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, sf, duck, name):
    same(queries.QUERIES[name](spark, sf), duck, queries.ORACLES[name])
