"""The queries that SQL can express, against DuckDB on whole tables."""

import pytest

from tests.compare import connect, same_rows
from turnstone.llm import queries

from .conftest import SF


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert same_rows(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE_SQL[name]) == []
