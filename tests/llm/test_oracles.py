"""The corpus operators that SQL can express, against DuckDB."""

import pytest
from lamina.llm import queries
from oracle import holds


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_duckdb(spark, name):
    holds(spark, queries.QUERIES[name], queries.ORACLES[name])
