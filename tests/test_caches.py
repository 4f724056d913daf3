import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pagequarry.operators import caches as K
from pagequarry.operators import usage as U
from pagequarry.streaming import streams as ST

NOW = datetime(2024, 5, 1, 12)
AS_OF = "TIMESTAMP_NTZ '2024-05-01 12:00:00'"
ENTRY = "k string, payload string, written_at timestamp_ntz, expires_at timestamp_ntz"


def entries(spark, *rows):
    return spark.createDataFrame([(k, p, NOW - timedelta(hours=1), NOW + timedelta(minutes=m)) for k, p, m in rows], ENTRY)


def test_hit_needs_equal_key_and_later_expiry(spark):
    cache = entries(spark, ("a", "live", 1), ("b", "now", 0), ("c", "gone", -1), ("", "blank", 1))
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("",), (None,)], "k string")
    hits, misses = K.cache_lookup(asked, cache, "k", F.expr(AS_OF))
    assert [(r["k"], r["payload"]) for r in hits.collect()] == [("a", "live")]
    assert sorted(str(r["k"]) for r in misses.collect()) == ["", "None", "b", "c", "d"]


def test_upsert_last_write_wins_and_blank_keys_are_dropped(spark):
    cache = entries(spark, ("a", "old", 5))
    rows = [("a", "first", NOW), ("a", "second", NOW + timedelta(seconds=1)), ("", "x", NOW), (None, "x", NOW), ("b", "new", NOW)]
    written = K.cache_upsert(cache, spark.createDataFrame(rows, "k string, payload string, written_at timestamp_ntz"), "k", "24 HOURS")
    got = {r["k"]: (r["payload"], r["expires_at"]) for r in written.collect()}
    assert got == {"a": ("second", NOW + timedelta(hours=24, seconds=1)), "b": ("new", NOW + timedelta(hours=24))}


def test_purge_leaves_rows_that_expire_now(spark):
    cache = entries(spark, ("a", "live", 1), ("b", "now", 0), ("c", "gone", -1))
    kept, counts = K.purge_expired({"one": cache, "two": None}, F.expr(AS_OF))
    assert {r["k"] for r in kept["one"].collect()} == {"a", "b"}
    assert {(r["cache_name"], r["deleted"]) for r in counts.collect()} == {("one", 1), ("two", 0)}


def test_tiers_in_order_and_clear_cache(spark):
    cache = entries(spark, ("a", "x", 1))
    tiers = [("analysis", "u", cache.withColumnRenamed("k", "u")), ("entity", "e", cache.withColumnRenamed("k", "e"))]
    asked = spark.createDataFrame(
        [(1, "a", "a", False), (2, "z", "a", False), (3, "a", "a", True), (4, "a", "z", True), (5, None, None, False)],
        "id int, u string, e string, clear_cache boolean",
    )
    got = {r["id"]: r["tier"] for r in K.partition_by_cache_tier(asked, tiers, F.expr(AS_OF)).collect()}
    assert got == {1: "analysis", 2: "entity", 3: "entity", 4: "none", 5: "none"}


def test_replay_agrees_with_a_loop(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice("aaab"), NOW + timedelta(minutes=rng.randint(0, 900))) for i in range(400)]
    rows += [(1000, "c", NOW), (1001, "c", NOW + timedelta(hours=1)), (1002, "c", NOW + timedelta(minutes=59))]
    asked = spark.createDataFrame(rows, "id int, k string, ts timestamp_ntz")
    got = {r["id"]: (r["hit"], r["entry_id"]) for r in K.replay_ttl(asked, "k", "ts", "id", timedelta(hours=1), NOW, NOW + timedelta(hours=15)).collect()}
    wanted, entry = {}, {}
    for i, k, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        open_id, expires = entry.get(k, (None, datetime.min))
        hit = ts < expires
        if not hit:
            entry[k] = open_id, expires = i, ts + timedelta(hours=1)
        wanted[i] = (hit, open_id)
    assert got == wanted
    assert got[1002] == (True, 1000) and got[1001] == (False, 1001)


def test_only_clean_fanout_results_are_cacheable(spark):
    rows = [(1, "text", None), (2, "text", "failed"), (3, None, None), (4, "", ""), (5, "text", "")]
    kept = K.fanout_cacheable(spark.createDataFrame(rows, "id int, analysis string, error string"))
    assert [r["id"] for r in kept.collect()] == [1, 5]


def test_usage_rules(spark):
    profile = "user_id long, email string, free_analyses_used int, free_analyses_reset_at timestamp_ntz"
    later, before = NOW + timedelta(days=1), NOW - timedelta(days=1)
    rows = [(1, "a@Partner.example", 9, later), (2, "a@x.org", 9, before), (3, "a@x.org", 5, later), (4, "a@x.org", 2, later), (5, None, None, later)]
    profiles = spark.createDataFrame(rows, profile)
    users = spark.range(1, 7).withColumnRenamed("id", "user_id")
    got = {r["user_id"]: (r["allowed"], r["remaining"], r["unlimited"]) for r in U.check_usage(users, profiles, F.expr(AS_OF), ["partner.example"]).collect()}
    assert got == {1: (True, None, True), 2: (True, 5, False), 3: (False, 0, False), 4: (True, 3, False), 5: (True, 5, False), 6: (False, 0, False)}
    reset = {r["user_id"]: (r["free_analyses_used"], r["free_analyses_reset_at"]) for r in U.monthly_reset(profiles, F.expr(AS_OF)).collect()}
    assert reset[2] == (0, datetime(2024, 6, 1)) and reset[3] == (5, later)
    runs = spark.createDataFrame([(1,), (3,), (3,)], "user_id long")
    added = {r["user_id"]: r["free_analyses_used"] for r in U.increment_usage(profiles, runs, ["partner.example"]).collect()}
    assert added == {1: 9, 2: 9, 3: 7, 4: 2, 5: 0}


def test_quota_starts_again_each_month(spark):
    rows = [(i, 1, datetime(2024, 1, 31, i)) for i in range(7)] + [(10 + i, 1, datetime(2024, 2, 1, i)) for i in range(6)]
    got = U.quota_replay(spark.createDataFrame(rows, "event_id int, user_id long, ts timestamp_ntz"))
    assert sorted(r["event_id"] for r in got.filter("NOT allowed").collect()) == [5, 6, 15]


def test_log_is_written_by_month(spark, tmp_path):
    rows = [(1, "u", "full", "byok", None, 3, NOW), (2, None, None, "byok", 1, 1, NOW), (None, "u", "paste", "free_tier", 4, None, NOW - timedelta(days=32))]
    runs = spark.createDataFrame(rows, "user_id long, url string, analysis_type string, key_source string, entities_found int, processing_time_ms int, created_at timestamp_ntz")
    U.append_log(runs, str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert sorted((r["entities_found"], r["processing_time_ms"], str(r["month"])) for r in log.collect()) == [(0, 3, "2024-05-01"), (4, 0, "2024-03-01")]


def test_streams_over_arriving_files(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = "event_id long, ts timestamp_ntz, user_id long, content_hash string, hit boolean"
    first = [(1, NOW, 1, "h", False), (2, NOW + timedelta(hours=1), 1, "h", True), (3, NOW + timedelta(hours=3), 2, "g", True)]
    second = [(4, NOW + timedelta(minutes=1), 1, "k", True), (5, NOW + timedelta(hours=6), 1, "h", True)]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(folder)
    arriving = ST.read_stream(spark, folder, "*.parquet", spark.read.parquet(folder).schema)
    usage_folder, rate_folder, content_folder = (str(tmp_path / n) for n in ("usage", "rate", "content"))
    ST.write_usage(ST.usage_counts(arriving), usage_folder)
    ST.write_hit_rate(ST.hit_rate(arriving), rate_folder)
    ST.write_new_content(arriving, content_folder)
    spark.createDataFrame(second, schema).coalesce(1).write.mode("append").parquet(folder)
    rates = ST.write_hit_rate(ST.hit_rate(arriving), rate_folder)
    # Event 4 is later than the watermark and is dropped; the open hour of event 5 is there.
    assert sorted((r["requests"], r["hits"]) for r in rates.collect()) == [(1, 0), (1, 1), (1, 1), (1, 1)]
    content = ST.write_new_content(arriving, content_folder)
    assert sorted(r["event_id"] for r in content.collect()) == [1, 3, 4]


def test_new_content_is_the_same_for_one_batch_and_many(spark, tmp_path):
    """Entries expire by event time: hash h is needed at hours 0, 25 and 49, however the log is cut."""
    hours = [(1, 0, "h"), (2, 1, "g"), (3, 23, "h"), (4, 25, "h"), (5, 26, "g"), (6, 48, "h"), (7, 49, "h"), (8, 80, "g")]
    rows = [(i, NOW + timedelta(hours=t), h) for i, t, h in hours]
    for cut in (8, 3, 1):
        folder, out = str(tmp_path / f"in{cut}"), str(tmp_path / f"out{cut}")
        for at in range(0, 8, cut):
            spark.createDataFrame(rows[at : at + cut], "event_id long, ts timestamp_ntz, content_hash string").coalesce(1).write.mode("append").parquet(folder)
        arriving = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
        assert sorted(r["event_id"] for r in ST.write_new_content(arriving, out).collect()) == [1, 2, 4, 5, 7, 8]


def test_stream_usage_keeps_the_latest_count(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "event_id long, ts timestamp_ntz, user_id long"
    for batch in range(3):
        rows = [(batch * 10 + i, NOW + timedelta(days=batch, minutes=i), i % 2) for i in range(4)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    arriving = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    kept = ST.write_usage(ST.usage_counts(arriving), out)
    assert sorted((r["user_id"], r["runs"]) for r in kept.collect()) == [(0, 6), (1, 6)]
    # A later run goes on from the stored state.
    spark.createDataFrame([(99, NOW, 0)], schema).coalesce(1).write.mode("append").parquet(folder)
    kept = ST.write_usage(ST.usage_counts(arriving), out)
    assert sorted((r["user_id"], r["runs"]) for r in kept.collect()) == [(0, 7), (1, 6)]
