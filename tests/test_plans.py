"""Every query with a SQL twin gives the twin's rows."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for path in Path(data).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(n for n in SQL if not re.match(r"p\d+_", n)))
def test_twin(spark, duck, data, name):
    frame = QUERIES[name](spark, data)
    names = sorted(frame.columns)
    ours = sorted((tuple(r[c] for c in names) for r in frame.collect()), key=key)
    done = duck.execute(SQL[name])
    columns = [d[0] for d in done.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    theirs = sorted((tuple(r[i] for i in order) for r in done.fetchall()), key=key)
    assert ours == theirs


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.count() > 0 and frame.columns == ["query_id", "key", "boosted_e9"]
