"""Every registered query against its checking SQL on the smallest given scale."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry_points
from musterline import catalog

FOLDER = "/root/testdata/sf0.001"
# The queries of the optional part are tested beside it.
QUERIES = {name: query for name, query in entry_points.queries().items() if name in catalog.QUERIES}
CHECKS = entry_points.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    return connection


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (Decimal, float)):
        return float(value)
    return value if value is None or isinstance(value, (bool, int)) else str(value)


def comparable(rows, columns):
    seats = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in seats) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    if name not in CHECKS:
        assert rows
        return
    checked = duck.execute(CHECKS[name])
    columns = [c[0] for c in checked.description]
    assert sorted(df.columns) == sorted(columns)
    assert comparable(rows, df.columns) == comparable(checked.fetchall(), columns)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
