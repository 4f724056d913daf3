"""Stored caches against a dictionary."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from pagequarry.operators.stores import CacheStore, lifetime, purge_stores

START = datetime.datetime(2024, 1, 1)


def store(spark, path, ttl="24 hours", buckets=4):
    return CacheStore(spark, f"{path}/cache", "k", ttl, "v bigint", buckets=buckets)


def rows(spark, given):
    return spark.createDataFrame([(k, v, START + datetime.timedelta(hours=h)) for k, v, h in given], "k string, v bigint, written_at timestamp_ntz")


def at(hours):
    return START + datetime.timedelta(hours=hours)


def moment(hours):
    return F.lit(at(hours).isoformat(sep=" ")).cast("timestamp_ntz")


def found(df):
    return {r["k"]: (r["v"], r["written_at"]) for r in df.collect()}


def test_store_keeps_the_last_write_of_each_key(spark, tmp_path):
    random.seed(1)
    cache, wanted = store(spark, tmp_path), {}
    assert cache.entries().count() == 0 and cache.live(moment(0)).count() == 0
    for day in range(3):
        given = [(random.choice(["", None, *"abcdefgh"]), random.randrange(100), day * 24 + h) for h in random.sample(range(24), 12)]
        cache.upsert(rows(spark, given))
        for k, v, h in sorted(given, key=lambda x: x[2]):
            if k:
                wanted[k] = (v, at(h))
    assert found(cache.entries()) == wanted
    for hours in (10, 30, 47.5, 80):
        live = {k: w for k, w in wanted.items() if w[1] + datetime.timedelta(hours=24) > at(hours)}
        assert found(cache.live(moment(hours))) == live
        asked = spark.createDataFrame([(k, n) for n, k in enumerate([*"aabcxyz", "", None])], "k string, n int")
        got = {r["n"]: r["_entry"] and r["_entry"]["v"] for r in cache.lookup(asked, moment(hours)).collect()}
        assert got == {n: live[k][0] if k in live else None for n, k in enumerate([*"aabcxyz", "", None])}


def test_an_upsert_writes_its_own_rows_only(spark, tmp_path):
    cache = store(spark, tmp_path)
    cache.upsert(rows(spark, [(f"k{n}", n, 0) for n in range(2000)]))
    files = lambda: {f"{d}/{f}": os.path.getmtime(f"{d}/{f}") for d, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet")}
    before = files()
    cache.upsert(rows(spark, [("k7", -7, 1)]))
    after = files()
    assert before.items() <= after.items() and len(after) == len(before) + 1
    assert found(cache.entries())["k7"][0] == -7 and cache.entries().count() == 2000


def test_lookups_and_purges_read_few_partitions(spark, tmp_path):
    cache = store(spark, tmp_path)
    cache.upsert(rows(spark, [(f"k{n}", n, n) for n in range(200)]))
    for df in (cache.live(moment(100)), cache.expired(moment(100))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(expires_day" in plan or "expires_day" in plan.split("PartitionFilters: [")[1].split("]")[0]


@pytest.mark.parametrize("hours", [0, 24, 36, 36.5, 400])
def test_purge_drops_what_has_expired(spark, tmp_path, hours):
    """A row that expires exactly now is neither served nor purged; the days before go as folders."""
    cache = store(spark, tmp_path, ttl="12 hours")
    given = [(f"k{n % 30}", n, n) for n in range(60)]
    cache.upsert(rows(spark, given[:30]))
    cache.upsert(rows(spark, given[30:]))
    last = {k: (v, at(h)) for k, v, h in given}
    kept = {k: w for k, w in last.items() if w[1] + datetime.timedelta(hours=12) >= at(hours)}
    assert purge_stores({"a": cache, "b": None}, at(hours)) == {"a": len(last) - len(kept), "b": 0}
    assert found(cache.entries()) == kept
    assert cache.expired(moment(hours)).count() == 0
    served = {k: w for k, w in kept.items() if w[1] + datetime.timedelta(hours=12) > at(hours)}
    assert found(cache.live(moment(hours))) == served
    assert purge_stores({"a": cache}, at(hours)) == {"a": 0}


def test_closed_days_are_folded_once(spark, tmp_path):
    cache = store(spark, tmp_path)
    for n in range(5):
        cache.upsert(rows(spark, [("a", n, n), ("b", 10 + n, n), ("c", n, 30 + n)]))
    before = found(cache.entries())
    # At noon of the first day entries can still get the next day's expiry; a day later that day is closed.
    assert cache.fold(at(12)) == 0
    assert cache.fold(at(30)) == 1 and cache.fold(at(30)) == 0
    assert found(cache.entries()) == before
    assert cache.rows().filter("k IN ('a', 'b')").count() == 2 and cache.rows().filter("k = 'c'").count() == 5


def test_lifetimes():
    assert lifetime("24 hours") == datetime.timedelta(days=1) and lifetime("1 hour") == datetime.timedelta(hours=1)
