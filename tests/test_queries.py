"""Every registered query of the repair operators against its SQL, on the smallest tables."""

import pytest
from mendlake.plans import code_queries, file_queries, queries  # noqa: F401
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, sf, duck, name):
    same(queries.QUERIES[name](spark, sf), duck, queries.ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
