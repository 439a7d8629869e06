"""Every registered query against its SQL oracle."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
import registry

QUERIES = registry.QUERIES
ORACLES = registry.ORACLES


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"create view {file.stem} as select * from '{file}'")
    return connection


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value if not isinstance(value, bool) else str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return "nan" if math.isnan(value) else f"{float(value):.12g}"
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return str(value)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple("" if v is None else "1" + v for v in r))


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, con, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    made = [tuple(plain(row[c]) for c in columns) for row in frame.collect()]
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    expected = [tuple(plain(row[i]) for i in places) for row in cursor.fetchall()]
    assert ordered(made) == ordered(expected)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
