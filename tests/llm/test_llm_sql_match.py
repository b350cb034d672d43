"""Every llm query that has SQL gives the rows that DuckDB gives over the same tables."""

import pytest
from compare import DATA, duck, spark_rows

from decistrata.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    columns, rows = spark_rows(QUERIES[name](spark, DATA))
    other_columns, other = duck(SQL[name])
    assert columns == other_columns
    assert rows == other


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
