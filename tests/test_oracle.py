"""Every registered query of the language against its SQL in DuckDB."""

import os

import pytest

from tests.oracle import duck_rows, spark_rows
from tidewater.queries import oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    df = queries()[name](spark, SF)
    want, columns = duck_rows(oracle_sql()[name], SF)
    assert sorted(df.columns) == columns
    assert spark_rows(df) == want
