"""The new training-data queries against their SQL on the smallest tables."""

import pytest
from comparing import connect, rows_of, rows_of_sql

from catalume.llm import queries


@pytest.mark.parametrize("name", sorted(n for n in queries.oracle_sql() if n.startswith(("op11", "op12", "op13"))))
def test_query(spark, small, name):
    cols, rows = rows_of(queries.queries()[name](spark, small))
    want_cols, want = rows_of_sql(connect(small), queries.oracle_sql()[name])
    assert cols == want_cols
    assert rows == want
