"""Registered queries against their SQL twins on the smallest tables."""

import collections
import datetime

import duckdb
import pytest

import __spark_entry__ as entry_points
from pagequarry.plans import oracles as _oracles

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return float(value) if type(value).__name__ == "Decimal" else value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return collections.Counter(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(_oracles.registry()))
def test_matches_sql(spark, oracle, name):
    found = entry_points.queries()[name](spark, SF)
    wanted = oracle.sql(entry_points.oracle_sql()[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert bag(found.columns, found.collect()) == bag(wanted.columns, wanted.fetchall())


def test_every_twin_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry_runs(spark):
    assert entry_points.entry(spark).count() > 0
