"""The queries that have SQL twins, on the smallest tables."""

import collections

import duckdb
import pytest
from helpers import SF

from pagequarry.llm import oracles, queries


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(oracles.registry()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found, wanted = queries.registry()[name](spark, SF), con.sql(oracles.registry()[name])
    columns = sorted(wanted.columns)
    assert set(columns) == set(found.columns)
    assert collections.Counter(tuple(map(plain, r)) for r in found.select(*columns).collect()) == collections.Counter(tuple(map(plain, r)) for r in wanted.project(", ".join(columns)).fetchall())
