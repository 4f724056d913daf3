"""TTL caches as keyed tables: lookup, upsert, purge, tiers, and replay of a request log."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry import rules
from pagequarry.functions.skew import spread_join
from pagequarry.functions.text import md5_key
from pagequarry.session import settle


def live(cache: DataFrame, as_of: Column) -> DataFrame:
    """Entries that are still served at ``as_of``; the predicate reaches the parquet scan."""
    return cache.filter(F.col("expires_at") > as_of)


def cache_lookup(requests: DataFrame, cache: DataFrame, key: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """``(hits, misses)``: hits carry the cached columns; an empty or NULL key misses.

    The cache has one row per key, so a hot key makes a large probe partition only, which the adaptive skew join
    splits.
    """
    served = live(cache, as_of).filter(F.col(key) != "")
    return requests.join(served, key), requests.join(served.select(key), key, "left_anti")


def cache_lookup_batch(names: DataFrame, cache: DataFrame, as_of: Column) -> DataFrame:
    """All names with their cached ``data`` (NULL on a miss); ``lower_name`` is the result key."""
    served = live(cache, as_of).select("entity_hash", "data")
    keyed = names.withColumns({"entity_hash": md5_key(F.col("name")), "lower_name": F.lower("name")})
    return keyed.join(served, "entity_hash", "left")


def expiring(rows: DataFrame, ttl: str, written_at: str = "written_at") -> DataFrame:
    """Adds ``expires_at = written_at + ttl``."""
    return rows.withColumn("expires_at", F.col(written_at) + F.expr(f"INTERVAL {ttl}"))


def cache_upsert(cache: DataFrame, rows: DataFrame, key: str, ttl: str) -> DataFrame:
    """The cache after writing ``rows``: the last write per key wins, an incoming row beats a stored one of the same time.

    ``cache`` and ``rows`` have the same payload columns and ``written_at``. Row number 1 is pre-limited per task
    before the shuffle, so many writes of one key stay cheap. Rows without a key are dropped.
    """
    incoming = expiring(rows, ttl).withColumn("_new", F.lit(1))
    merged = cache.withColumn("_new", F.lit(0)).unionByName(incoming).filter(F.coalesce(F.col(key), F.lit("")) != "")
    latest = Window.partitionBy(key).orderBy(F.col("written_at").desc(), F.col("_new").desc())
    return merged.withColumn("_rn", F.row_number().over(latest)).filter("_rn = 1").drop("_rn", "_new")


def entity_rows(linked: DataFrame) -> DataFrame:
    """Linked entities as rows of the entity cache: ``(entity_hash, entity_name, data, written_at)``."""
    payload = [c for c in linked.columns if c not in ("page_id", "pos", "written_at", "linkedin_url")]
    return linked.select(
        md5_key(F.col("name")).alias("entity_hash"),
        F.lower("name").alias("entity_name"),
        F.to_json(F.struct(*payload)).alias("data"),
        "written_at",
    )


def cache_upsert_entities(cache: DataFrame, linked: DataFrame) -> DataFrame:
    """One-row and bulk entity upsert; entries live seven days."""
    return cache_upsert(cache, entity_rows(linked), "entity_hash", rules.ENTITY_TTL)


def write_version(cache: DataFrame, root: str, version: str) -> str:
    """Write a new version of a cache table next to the old one and return its path."""
    path = f"{root}/version={version}"
    cache.write.mode("overwrite").parquet(path)
    return path


def purge_expired(caches: Mapping[str, DataFrame | None], as_of: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """``(kept tables, counts)``: rows with ``expires_at < as_of`` go; a missing table (None) counts 0.

    ``counts`` is ``(cache_name, deleted)`` with one row per table.
    """
    kept = {
        name: table.filter(F.coalesce(F.col("expires_at") >= as_of, F.lit(True)))
        for name, table in caches.items()
        if table is not None
    }
    some = next(iter(kept.values()))
    counts = None
    for name, table in caches.items():
        gone = some.filter(F.lit(False)) if table is None else table.filter(F.col("expires_at") < as_of)
        row = gone.agg(F.count("*").alias("deleted")).select(F.lit(name).alias("cache_name"), "deleted")
        counts = row if counts is None else counts.unionByName(row)
    return kept, counts


# ── replay of a request log ───────────────────────────────────────────────────


def replay_slice(requests: DataFrame, state: DataFrame, key: str, ts: str, row_id: str, ttl: str) -> DataFrame:
    """Hit or miss for a slice of the log that is no longer than the TTL.

    ``state`` is ``(key, entry_ts, entry_id, expires_at)``: entries open when the slice starts. Within one TTL a key
    can open at most one entry, at its first request that the stored entry does not serve; that is a minimum per key,
    combined before the shuffle, so no key is ever gathered.
    """
    served = requests.join(state, key, "left")
    unserved = F.col("expires_at").isNull() | (F.col(ts) >= F.col("expires_at"))
    opened = (
        served.filter(unserved)
        .groupBy(key)
        .agg(F.min(F.struct(F.col(ts).alias("t"), F.col(row_id).alias("id"))).alias("_open"))
    )
    marked = served.join(opened, key, "left")
    is_open = F.coalesce(F.struct(F.col(ts), F.col(row_id)) == F.col("_open"), F.lit(False))
    by_old = F.coalesce(F.col(ts) < F.col("expires_at"), F.lit(False))
    return marked.select(
        *requests.columns,
        (~is_open).alias("hit"),
        F.when(by_old, F.col("entry_ts")).otherwise(F.col("_open.t")).alias("entry_ts"),
        F.when(by_old, F.col("entry_id")).otherwise(F.col("_open.id")).alias("entry_id"),
    ).withColumn("expires_at", F.col("entry_ts") + F.expr(f"INTERVAL {ttl}"))


def replay_ttl(
    requests: DataFrame, key: str, ts: str, row_id: str, ttl: timedelta, start: datetime, end: datetime
) -> DataFrame:
    """What a TTL cache does over a request log from ``start`` to ``end``: every request as hit or miss of an entry.

    A miss opens an entry for ``ttl``; later requests before it expires hit; the next one re-opens. The log is walked
    in slices of one TTL. Only the open entries travel from slice to slice, and they are checkpointed, so each slice
    is planned on its own and a lost executor repeats one slice.
    """
    interval = f"{int(ttl.total_seconds())} SECONDS"
    done, lower = None, start
    state = _no_entries(requests, key, ts, row_id)
    while lower <= end:
        upper = lower + ttl
        window = requests.filter((F.col(ts) >= F.lit(lower).cast(_type(requests, ts))) & (F.col(ts) < F.lit(upper).cast(_type(requests, ts))))
        result = replay_slice(window, state, key, ts, row_id, interval)
        done = result if done is None else done.unionByName(result)
        if upper <= end:
            touched = result.filter(~F.col("hit")).select(key, "entry_ts", "entry_id", "expires_at")
            carried = state.join(touched.select(key), key, "left_anti")
            boundary = F.lit(upper).cast(_type(requests, ts))
            state = carried.unionByName(touched).filter(F.col("expires_at") > boundary)
            state = settle(state)
        lower = upper
    return done


def _type(df: DataFrame, column: str):
    return df.schema[column].dataType


def _no_entries(requests: DataFrame, key: str, ts: str, row_id: str) -> DataFrame:
    return requests.select(
        key, F.col(ts).alias("entry_ts"), F.col(row_id).alias("entry_id"), F.col(ts).alias("expires_at")
    ).filter(F.lit(False))


def cache_hit_counts(replayed: DataFrame, key: str) -> DataFrame:
    """Hits per entry, from :func:`replay_ttl`; writing an entry starts its count at 0."""
    return replayed.groupBy(key, "entry_id").agg(F.sum(F.col("hit").cast("int")).alias("hit_count"))


def partition_by_cache_tier(requests: DataFrame, tiers: list[tuple[str, str, DataFrame]], as_of: Column) -> DataFrame:
    """Where each request is answered: the first tier with a live entry, ``none`` if all miss.

    ``tiers`` is ``(name, key column, cache)`` in short-circuit order. ``clear_cache`` requests skip every tier except
    the entity tier. A tier is asked only by requests that no earlier tier has answered: the others, and those without a
    key, carry no key into its join and are dealt out evenly.
    """
    out = requests.withColumn("_tier", F.lit(None).cast("string"))
    for name, key, cache in tiers:
        served = live(cache, as_of).select(F.col(key).alias("_key"), F.lit(name).alias("_found"))
        asks = F.when(F.col("_tier").isNull() & (~F.col("clear_cache") | F.lit(name == "entity")), F.col(key))
        out = spread_join(out.withColumn("_key", asks), served, ["_key"], requests.columns[0])
        out = out.withColumn("_tier", F.coalesce("_tier", "_found")).drop("_key", "_found")
    return out.select(*requests.columns, F.coalesce("_tier", F.lit("none")).alias("tier"))


def fanout_cacheable(results: DataFrame) -> DataFrame:
    """Only rows with an analysis and no error may be stored."""
    return results.filter((F.coalesce("analysis", F.lit("")) != "") & (F.coalesce("error", F.lit("")) == ""))
