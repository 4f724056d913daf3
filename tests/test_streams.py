"""Tables that streams keep."""

import collections
import datetime
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pagequarry.operators.stores import folder_numbers
from pagequarry.streaming import streams

START = datetime.datetime(2024, 1, 1)


def test_upserts_keep_the_rows_of_every_month(spark, tmp_path):
    """More months than 1,200 in each of two batches: the rows of the first stay unless the second replaces them."""
    months = 1300
    for number, key in enumerate(("a", "b")):
        at = "add_months(DATE'1900-01-01', CAST(id AS INT))"
        spark.range(0, months, 1, 1).selectExpr(f"'{key}' AS user_id", f"{at} AS day", f"CAST({number} AS LONG) AS runs", "TIMESTAMP'2024-01-01' AS written_at").unionByName(
            spark.range(0, 1, 1, 1).selectExpr("'c' AS user_id", "DATE'2024-01-01' AS day", f"CAST({number} AS LONG) AS runs", "TIMESTAMP'2024-01-01' AS written_at")
        ).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    kept = streams.write_usage(rows, str(tmp_path)).collect()
    assert len(kept) == 2 * months + 1
    assert [r["runs"] for r in kept if r["user_id"] == "c"] == [1]


def test_upserts_are_folded(spark, tmp_path, monkeypatch):
    """A hundred batches leave few folders, and the newest row of each key, also when a batch is repeated."""
    monkeypatch.setattr(streams, "FOLD", 8)
    root, wanted = f"{tmp_path}/table", {}
    schema = spark.createDataFrame([("a", 1)], "k string, v long").schema
    most = 0
    for number in range(100):
        rows = [(f"k{number % 7}", number), (f"only{number}", number)]
        wanted.update(rows)
        (tmp_path / f"table/rows/batch={number}").mkdir(parents=True)
        pq.write_table(pa.table({"k": [k for k, _ in rows], "v": [v for _, v in rows]}), f"{root}/rows/batch={number}/part-0.parquet")
        if (number + 1) % streams.FOLD == 0:
            streams.fold_upserts(spark, root, schema, ["k"], number)
        if number in (49, 99):
            most = max(most, len(folder_numbers(spark, f"{root}/rows")) + len(folder_numbers(spark, f"{root}/base")))
    assert {r["k"]: r["v"] for r in streams.read_upserts(spark, root, schema, ["k"]).collect()} == wanted
    assert most <= 2 * streams.FOLD + 2
    # A base that was not finished does not count.
    spark.createDataFrame([("k0", -1)], schema).write.parquet(f"{root}/base/upto=200")
    (tmp_path / "table/base/upto=200/_SUCCESS").unlink()
    assert {r["k"]: r["v"] for r in streams.read_upserts(spark, root, schema, ["k"]).collect()} == wanted


def openings(rows, seconds):
    """The requests that open an entry, by a walk over each hash's sorted requests."""
    out, until = [], {}
    for ts, h, i in sorted(rows):
        if h is not None and (h not in until or ts >= until[h]):
            until[h] = ts + datetime.timedelta(seconds=seconds)
            out.append(i)
    return sorted(out)


@pytest.fixture(scope="module")
def asked():
    """Requests of ten days in order of time, a third of them for one hash."""
    random.seed(5)
    times = sorted(random.sample(range(10 * 86_400), 3000))
    return [(START + datetime.timedelta(seconds=t), "hot" if k % 3 == 0 else f"h{random.randrange(40)}" if k % 50 else None, k) for k, t in enumerate(times)]


@pytest.mark.parametrize("batches", [1, 5])
def test_one_batch_and_many_open_the_same_entries(spark, tmp_path, asked, batches):
    per = len(asked) // batches
    for n in range(batches):
        part = spark.createDataFrame(asked[n * per : (n + 1) * per], "ts timestamp_ntz, content_hash string, event_id long")
        part.coalesce(1).write.parquet(f"{tmp_path}/part{n:02}")
    schema = spark.read.parquet(f"{tmp_path}/part00").schema
    # Folders are read in the order of their modification times.
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/part*")
    found = streams.write_new_content(rows, f"{tmp_path}/run", "6 hours")
    assert sorted(r["event_id"] for r in found.collect()) == openings(asked[: per * batches], 6 * 3600)


def test_an_older_request_is_served_by_a_later_entry(spark, tmp_path):
    at = lambda h: START + datetime.timedelta(hours=h)
    for n, rows in enumerate([[(at(10), "a", 1)], [(at(9), "a", 2), (at(11), "a", 3), (at(30), "b", 4)], [(at(35), "a", 5)]]):
        spark.createDataFrame(rows, "ts timestamp_ntz, content_hash string, event_id long").coalesce(1).write.parquet(f"{tmp_path}/part{n}")
    rows = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/part0").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/part*")
    assert sorted(r["event_id"] for r in streams.write_new_content(rows, f"{tmp_path}/run", "24 hours").collect()) == [1, 4, 5]


def test_hit_rate_leaves_out_late_rows(spark, tmp_path):
    """A row later than the delay is dropped from the second batch after the one that passed its hour; open hours are in the result."""
    at = lambda minutes: START + datetime.timedelta(minutes=minutes)
    for n, rows in enumerate([[(at(5), True), (at(50), False)], [(at(300), True)], [(at(305), True)], [(at(10), True), (at(310), False)]]):
        spark.createDataFrame(rows, "ts timestamp, hit boolean").coalesce(1).write.parquet(f"{tmp_path}/part{n}")
    rows = spark.readStream.schema("ts timestamp, hit boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/part*")
    found = streams.write_hit_rate(streams.hit_rate(rows), f"{tmp_path}/run").select(F.hour("hour").alias("h"), "requests", "hits").collect()
    assert collections.Counter(map(tuple, found)) == {(0, 2, 1): 1, (5, 3, 2): 1}


def test_a_table_is_a_file_or_a_folder_of_files(spark, tmp_path):
    """A stream reads every part of a table that is a folder, beside other tables, and a table that is one file."""
    pages = [[(n, "", f"<title>T{n}</title><article><p>body {n}</p></article>")] for n in range(3)]
    table = lambda rows: pa.table(dict(zip(("page_id", "url", "html"), map(list, zip(*rows)))))
    for folder, name, rows in (("parts", "pages.parquet/part-0.parquet", pages[0]), ("parts", "pages.parquet/part-1.parquet", pages[1] + pages[2]), ("parts", "other.parquet", [(9, "", "")]), ("file", "pages.parquet", sum(pages, []))):
        path = tmp_path / folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        pq.write_table(table(rows), path)
    for folder in ("parts", "file"):
        at = str(tmp_path / folder)
        arriving = streams.read_stream(spark, at, "pages.parquet", spark.read.parquet(f"{at}/pages.parquet").schema)
        path = streams.write_page_texts(arriving, f"{tmp_path}/run-{folder}")
        assert sorted((r["page_id"], r["title"]) for r in spark.read.parquet(path).collect()) == [(0, "T0"), (1, "T1"), (2, "T2")]
