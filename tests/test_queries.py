"""Every registered query against its SQL on the smallest test tables."""

import duckdb
import pytest

from checks.compare import TABLES, _rows
from checks.registry import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    got = _rows(df.columns, df.collect())
    cursor = db.execute(SQL[name])
    assert got == _rows([d[0] for d in cursor.description], cursor.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
