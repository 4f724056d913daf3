"""Streaming versions: new content, usage, hit rate, and arriving pages."""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry import rules
from pagequarry.operators import dom
from pagequarry.operators import page_text as P
from pagequarry.operators.stores import folder_exists, folder_numbers, is_folder, lifetime, remove_folder
from pagequarry.session import checkpoint_dir
from pagequarry.sources.pages import clean_pages


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run's state and output, in the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def read_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """Parquet files as they arrive: ``name`` under ``folder`` is one file or a folder of files."""
    source = spark.readStream.schema(schema)
    if is_folder(spark, f"{folder}/{name}"):
        return source.parquet(f"{folder}/{name}")
    return source.option("pathGlobFilter", name).parquet(folder)


def event_time(events: DataFrame) -> DataFrame:
    """``ts`` as a timestamp with time zone, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def write_new_content(requests: DataFrame, folder: str, ttl: str = rules.EXTRACTION_TTL) -> DataFrame:
    """Requests that need extraction: the first of each ``content_hash``, and again the first once an entry is ``ttl`` old.

    Event time is cut into slices of one lifetime. In a slice a hash opens at most one entry, at its first request that no
    entry serves: a minimum per hash, combined before the shuffle, so only openings leave a task and no hash is gathered.
    What may serve a slice was opened in the slice before or, by an earlier batch, in this one, so of all stored openings
    two partitions are read; stored openings are the only state. A batch walks its slices in order, so one batch and
    many give the same rows as long as batches follow each other in time; a request older than an entry that a batch before
    opened in its slice is served by it. A repeated batch overwrites its own rows. Returns the openings.
    """
    requests = event_time(requests)
    spark, names, seconds = requests.sparkSession, requests.columns, int(lifetime(ttl).total_seconds())
    root, slice_of = f"{folder}/openings", F.floor(F.unix_micros("ts") / (seconds * 1_000_000)).cast("long")
    schema = T.StructType([*requests.schema.fields, T.StructField("slice", T.LongType()), T.StructField("batch", T.LongType())])

    def openings() -> DataFrame:
        return spark.read.schema(schema).parquet(root) if folder_exists(spark, root) else spark.createDataFrame([], schema)

    def decide(batch: DataFrame, number: int) -> None:
        path = f"{folder}/sliced/batch={number}"
        batch.filter("content_hash IS NOT NULL AND ts IS NOT NULL").withColumn("slice", slice_of).write.mode("overwrite").partitionBy("slice").parquet(path)
        sliced = spark.read.schema(T.StructType(schema.fields[:-1])).parquet(path)
        for at in sorted(r["slice"] for r in sliced.select("slice").distinct().collect()):
            # This batch's own openings count in the slice before only: in this one they are what a failed attempt left.
            old = openings().filter(((F.col("slice") == at) & (F.col("batch") < number)) | ((F.col("slice") == at - 1) & (F.col("batch") <= number)))
            until = old.groupBy("content_hash").agg(F.max("ts").alias("_opened"))
            asked = sliced.filter(F.col("slice") == at).join(until, "content_hash", "left")
            open_ = asked.filter(F.col("_opened").isNull() | (F.col("ts") >= F.col("_opened") + F.expr(f"INTERVAL {seconds} SECONDS"))).drop("_opened")
            first = F.min_by(F.struct(*names), F.struct("ts", F.xxhash64(*names))).alias("row")
            opened = open_.groupBy("content_hash").agg(first).select("row.*", F.lit(at).alias("slice"), F.lit(number).cast("long").alias("batch"))
            opened.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slice", "batch").parquet(root)

    finish(requests.writeStream.foreachBatch(decide), folder)
    return openings().select(*names)


def usage_counts(runs: DataFrame, delay: str = "31 days") -> DataFrame:
    """Runs and the latest run per user and day, for update mode; state of days that ``delay`` has passed goes."""
    daily = event_time(runs).withWatermark("ts", delay).groupBy("user_id", F.window("ts", "1 day").alias("w"))
    counted = daily.agg(F.count("*").alias("runs"), F.max("ts").alias("written_at"))
    return counted.select("user_id", F.col("w.start").cast("date").alias("day"), "runs", "written_at")


def hit_rate(requests: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Requests and hits per hour, for update mode; rows later than ``delay`` are dropped. ``requests`` has ``hit``."""
    counted = event_time(requests).withWatermark("ts", delay).groupBy(F.window("ts", "1 hour").alias("w"))
    return counted.agg(F.count("*").alias("requests"), F.sum(F.col("hit").cast("int")).alias("hits")).select(
        F.col("w.start").alias("hour"), "requests", "hits"
    )


def write_usage(counts: DataFrame, folder: str) -> DataFrame:
    """Keep :func:`usage_counts` as a table under ``folder``; returns runs and the latest run per user and month."""
    month = F.trunc("day", "MM")
    kept = write_upserts(counts, f"{folder}/usage", folder, ["user_id", "day"])
    return kept.groupBy("user_id", month.alias("month")).agg(F.sum("runs").alias("runs"), F.max("written_at").alias("written_at"))


def write_hit_rate(rates: DataFrame, folder: str) -> DataFrame:
    """Keep :func:`hit_rate` as a table under ``folder``, hours that are still open included; returns it."""
    return write_upserts(rates, f"{folder}/rates", folder, ["hour"])


def write_upserts(rows: DataFrame, root: str, folder: str, keys: list[str]) -> DataFrame:
    """Append each batch of update-mode ``rows`` under its number; returns the newest row of each of ``keys``.

    A repeated batch overwrites its own rows only, and a skipped number does no harm. Every ``FOLD`` batches what is there is
    folded to one row per key, so the folders that are read stay few however long the stream runs.
    """

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch={number}")
        if (number + 1) % FOLD == 0:
            fold_upserts(rows.sparkSession, root, rows.schema, keys, number)

    finish(rows.writeStream.outputMode("update").foreachBatch(append), folder)
    return read_upserts(rows.sparkSession, root, rows.schema, keys)


#: Batches between two foldings of an upsert table.
FOLD = 16


def _upsert_rows(spark: SparkSession, root: str, schema: T.StructType) -> tuple[DataFrame, int]:
    """Rows of the newest finished base and of the batches after it, with ``batch``; and that base's number, -1 without one.

    A base counts once its folder has the writer's mark of success, so a reader sees the old base or the new one.
    """
    bases = [n for n in folder_numbers(spark, f"{root}/base") if folder_exists(spark, f"{root}/base/upto={n}/_SUCCESS")]
    upto = max(bases, default=-1)
    parts = [spark.read.schema(schema).parquet(f"{root}/rows/batch={n}").withColumn("batch", F.lit(n)) for n in folder_numbers(spark, f"{root}/rows") if n > upto]
    parts += [spark.read.schema(schema).parquet(f"{root}/base/upto={upto}").withColumn("batch", F.lit(upto))] if bases else []
    none = spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
    return reduce(DataFrame.unionByName, parts, none), upto


def read_upserts(spark: SparkSession, root: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The newest row of each of ``keys``."""
    newest = F.max_by(F.struct(*schema.names), "batch").alias("row")
    return _upsert_rows(spark, root, schema)[0].groupBy(*keys).agg(newest).select("row.*")


def fold_upserts(spark: SparkSession, root: str, schema: T.StructType, keys: list[str], number: int) -> None:
    """Write everything up to batch ``number`` as a new base. The base before stays for readers that have begun; older folders go."""
    _, before = _upsert_rows(spark, root, schema)
    read_upserts(spark, root, schema, keys).write.mode("overwrite").parquet(f"{root}/base/upto={number}")
    for n in folder_numbers(spark, f"{root}/rows"):
        if n <= before:
            remove_folder(spark, f"{root}/rows/batch={n}")
    for n in folder_numbers(spark, f"{root}/base"):
        if n < before:
            remove_folder(spark, f"{root}/base/upto={n}")


def write_page_texts(pages: DataFrame, folder: str) -> str:
    """Parse each batch of arriving pages and append its page text; stateless."""
    path = f"{folder}/page_text"

    def parse(batch: DataFrame, number: int) -> None:
        P.page_text(dom.parse_pages(clean_pages(batch))).write.mode("overwrite").parquet(f"{path}/batch={number}")

    finish(pages.writeStream.foreachBatch(parse), folder)
    return path


def finish(writer, folder: str) -> None:
    """Process everything that has arrived, then stop."""
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
