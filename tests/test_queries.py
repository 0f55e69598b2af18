"""Every catalog query against its SQL on the smallest tables; those without SQL must have rows."""

import pytest
from comparing import connect, rows_of, rows_of_sql

from catalume.plans import catalog_queries, entity_queries  # noqa: F401
from catalume.plans.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, small, con, name):
    cols, rows = rows_of(QUERIES[name](spark, small))
    if name in SQL:
        want_cols, want = rows_of_sql(con, SQL[name])
        assert cols == want_cols
        assert rows == want
    else:
        assert rows
