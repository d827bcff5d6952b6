"""The corpus queries with SQL against DuckDB on the smallest tables."""

import os

import pytest

from tests.test_oracles import DATA, compare, duck  # noqa: F401
from tidewatch.llm import queries


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, name):  # noqa: F811
    compare(spark, duck, queries.QUERIES[name], queries.ORACLES[name])
