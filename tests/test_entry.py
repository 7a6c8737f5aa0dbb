"""Registered queries against DuckDB on the smallest tables."""

import datetime
import decimal
import os

import pytest

import __spark_entry__ as entry
from ledgerloom.plans.catalog import all_queries

duckdb = pytest.importorskip("duckdb")

NAMES = list(all_queries())


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return int(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value


def test_every_library_query_has_sql():
    assert set(all_queries()) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "month"


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, sf_dir, name):
    frame = entry.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in frame.collect())
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(str([plain(r[i]) for i in at]) for r in result.fetchall())
