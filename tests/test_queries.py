"""Every registered query against its DuckDB SQL on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as registered
from watchhouse import workload
from watchhouse.workload.registry import SQL as REGISTERED_SQL
from watchhouse.workload.tables import GIVEN

FOLDER = "/root/testdata/sf0.001"
QUERIES = dict(workload.queries())
SQL = dict(REGISTERED_SQL)
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def _sorted(rows, columns, order):
    picked = [tuple(row[columns.index(name)] for name in order) for row in rows]
    return sorted(picked, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, FOLDER)
    mine = [tuple(row) for row in df.collect()]
    cursor = duck.execute(SQL[name])
    described = {c[0]: TYPES[str(c[1])] for c in cursor.description}
    theirs = cursor.fetchall()
    assert dict(df.dtypes) == described
    order = sorted(df.columns)
    assert _sorted(mine, df.columns, order) == _sorted(theirs, list(described), order)


def test_entry(spark):
    assert registered.entry(spark).count() == 15
