"""Helpers the operators share: session settings, tables in the shared folder, Arrow columns."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.session import checkpoint_dir, ship

#: Rows an Arrow batch may hold: documents average a few kilobytes, so a batch stays near ten megabytes.
BATCH_ROWS = "2000"


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings: batch size, adaptive joins, and shuffle files removed as soon as their query has ended."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later reads do not repeat its work, whichever executor is lost."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip("/")}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: str, modulus: int, remainder: int):
    """Whether ``crc32(doc_id as text) mod modulus`` is ``remainder``; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, each: bool, salt: int) -> DataFrame:
    """``(doc_id, text, label)`` of about ``rows`` labelled documents, of each label where ``each``; never over twice that.

    The ids are chosen in ``labels(doc_id, label)`` by a hash and sent to the scan of ``docs``, so texts are not shuffled.
    """
    known = labels.filter("label IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("label").cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not each:
        sizes = {k: sum(sizes.values()) for k in sizes}
    share = (F.xxhash64(F.col("doc_id").cast("string"), F.lit(salt)) / F.lit(float(1 << 63)) + 1) / 2
    wanted = F.when(F.col("label") == 1, rows / max(1, sizes.get(1, 0))).otherwise(rows / max(1, sizes.get(0, 0)))
    chosen = known.filter(share < wanted).limit(4 * rows)
    return written(docs.filter("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts(rows: int, per_part: int) -> int:
    return max(1, math.ceil(rows / per_part))


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its values in them; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of values that hold up to ``most`` elements together; a longer value is a range of its own."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()
