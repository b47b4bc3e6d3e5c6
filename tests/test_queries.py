"""Every query of the core runs; those with SQL give the rows DuckDB gives."""

import pytest
from compare import duck_rows, spark_rows

from corvane.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, data, name):
    columns, rows = spark_rows(QUERIES[name](spark, data))
    expected_columns, expected = duck_rows(SQL[name], data)
    assert columns == expected_columns
    assert rows == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns
    df.count()


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
