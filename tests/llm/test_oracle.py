"""Registered queries of the operators against their SQL in DuckDB."""

import pytest

from tests.oracle import duck_rows, spark_rows
from tidewater.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    df = QUERIES[name](spark, sf_dir)
    want, columns = duck_rows(ORACLE_SQL[name], sf_dir)
    assert sorted(df.columns) == columns
    assert spark_rows(df) == want
