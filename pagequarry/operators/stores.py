"""TTL caches kept as stored tables: partitions by expiry day and key bucket.

An upsert appends its own rows only, so the bytes it writes follow the change and not the cache. All entries of a table
live equally long, so the newest write of a key also expires last: readers take the newest row per key, and a lookup or a
purge reads only the expiry days that can matter, by partition pruning. Appends that are repeated after a failure do no
harm. Days that can get no more entries are folded to one row per key and one file per bucket.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.operators.caches import expiring
from pagequarry.session import settle

#: Key buckets of a table: a lookup of few keys reads their buckets only.
BUCKETS = 64
#: Partition columns; they are not part of an entry.
PARTITIONS = ("expires_day", "bucket")


def folder_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder_exists(spark, path) and at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def folder_numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the folders ``name=number`` under ``path``, rising."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
    return sorted(int(n.split("=")[1]) for n in names if "=" in n)


def remove_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class CacheStore:
    """A stored cache under ``root`` with one entry per ``key``; ``payload`` is a DDL string of its other columns.

    ``ttl`` is how long every entry lives, such as ``"1 hour"``. Entries have ``written_at`` and ``expires_at``.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, ttl: str, payload: str, clock: str = "timestamp_ntz", buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.key, self.ttl, self.buckets = spark, root.rstrip("/"), key, ttl, buckets
        self.schema = f"`{key}` string, {payload}, written_at {clock}, expires_at {clock}, expires_day date, bucket int"

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def rows(self) -> DataFrame:
        """Everything stored, older writes of a key too, with the partition columns."""
        if not folder_exists(self.spark, self.root):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.root)

    def _newest(self, rows: DataFrame) -> DataFrame:
        """One row per key, the last write. Maxima are combined before the shuffle, so many writes of a key stay cheap."""
        names = [c for c in rows.columns if c != self.key]
        best = F.max_by(F.struct(*[f"`{c}`" for c in names]), F.struct("written_at", F.xxhash64(*[f"`{c}`" for c in rows.columns if c not in PARTITIONS]))).alias("_row")
        return rows.groupBy(self.key).agg(best).select(self.key, "_row.*")

    def entries(self) -> DataFrame:
        """The newest entry of each key, expired ones too."""
        return self._newest(self.rows()).drop(*PARTITIONS)

    def live(self, as_of: Column) -> DataFrame:
        """Entries that are served at ``as_of``. Days before are not read."""
        served = self.rows().filter((F.col("expires_day") >= as_of.cast("date")) & (F.col("expires_at") > as_of))
        return self._newest(served).drop(*PARTITIONS)

    def lookup(self, requests: DataFrame, as_of: Column) -> DataFrame:
        """``requests`` with ``_entry``, the live entry of their key as a struct; NULL is a miss, as is a blank key.

        Asked keys are reduced to one row each and meet the stored rows by bucket and key before anything is ranked, so
        only entries that are asked for are shuffled twice, and a small set of keys prunes the buckets that are read. The
        way back is a join of plain exchanges, whose hot keys the adaptive skew join splits.
        """
        payload = T.StructType([f for f in T.StructType.fromDDL(self.schema).fields if f.name not in (self.key, *PARTITIONS)])
        if not folder_exists(self.spark, self.root):  # nothing was ever stored
            return requests.withColumn("_entry", F.lit(None).cast(payload))
        asked = requests.select(self.key).filter(F.coalesce(self.key, F.lit("")) != "").distinct().withColumn("bucket", self._bucket(F.col(self.key)))
        served = self.rows().filter((F.col("expires_day") >= as_of.cast("date")) & (F.col("expires_at") > as_of))
        found = self._newest(served.join(asked, [self.key, "bucket"], "left_semi")).drop(*PARTITIONS)
        entry = found.select(self.key, F.struct(*payload.names).alias("_entry"))
        return requests.join(settle(entry), self.key, "left")

    def upsert(self, rows: DataFrame) -> None:
        """Write ``rows(key, payload…, written_at)``: per key the last of them; blank keys are dropped."""
        fields = T.StructType.fromDDL(self.schema).names[:-3]
        latest = Window.partitionBy(self.key).orderBy(F.col("written_at").desc())
        new = expiring(rows.select(*fields), self.ttl).filter(F.coalesce(self.key, F.lit("")) != "")
        new = new.withColumn("_rn", F.row_number().over(latest)).filter("_rn = 1").drop("_rn")
        self._write(new, "append")

    def _write(self, rows: DataFrame, mode: str) -> None:
        parts = rows.withColumn("expires_day", F.col("expires_at").cast("date")).withColumn("bucket", self._bucket(F.col(self.key)))
        writer = parts.repartition(*PARTITIONS).write.mode(mode).partitionBy(*PARTITIONS)
        writer.option("partitionOverwriteMode", "dynamic").parquet(self.root)

    def expired(self, as_of: Column) -> DataFrame:
        """Rows with ``expires_at < as_of``: whole days by their partition, and the boundary day by time."""
        day = as_of.cast("date")
        return self.rows().filter((F.col("expires_day") < day) | ((F.col("expires_day") == day) & (F.col("expires_at") < as_of)))

    def purge(self, as_of: datetime) -> int:
        """Remove what has expired and return how many keys went. Days are dropped as folders; the boundary day alone is rewritten."""
        moment = F.lit(as_of).cast(self.rows().schema["expires_at"].dataType)
        # A key whose newest write is still kept has not gone.
        gone = self._newest(self.expired(moment)).select(self.key)
        kept = self.rows().filter((F.col("expires_day") >= moment.cast("date")) & (F.col("expires_at") >= moment))
        count = gone.join(kept.select(self.key), self.key, "left_anti").count()
        today = self.rows().filter(F.col("expires_day") == moment.cast("date"))
        left = settle(today.filter(F.col("expires_at") >= moment))
        touched = [r["bucket"] for r in today.filter(F.col("expires_at") < moment).select("bucket").distinct().collect()]
        self._replace(left.filter(F.col("bucket").isin(touched)) if touched else None, [(as_of.date().isoformat(), b) for b in touched])
        for day in [r["expires_day"] for r in self.rows().select("expires_day").distinct().collect() if r["expires_day"] < as_of.date()]:
            self._remove(f"expires_day={day.isoformat()}")
        return count

    def fold(self, as_of: datetime) -> int:
        """Rewrite each day that can get no more entries at ``as_of`` to one row per key; returns how many days were folded.

        An entry written from now on expires a lifetime later, so earlier expiry days are closed. A folded day has one file
        a bucket and is left alone.
        """
        found = self.rows().filter(F.col("expires_day") < F.lit((as_of + lifetime(self.ttl)).date())).select("expires_day", "bucket", F.input_file_name().alias("file"))
        many = found.groupBy("expires_day", "bucket").agg(F.count_distinct("file").alias("files")).filter("files > 1")
        days = sorted({r["expires_day"] for r in many.select("expires_day").distinct().collect()})
        for day in days:
            rows = self.rows().filter(F.col("expires_day") == F.lit(day))
            self._write(settle(self._newest(rows).drop(*PARTITIONS)), "overwrite")
        return len(days)

    def _replace(self, rows: DataFrame | None, touched: list[tuple[str, int]]) -> None:
        """Overwrite the touched partitions of one day with ``rows``; those with nothing left are removed."""
        if not touched:
            return
        left = {r["bucket"] for r in rows.select("bucket").distinct().collect()}
        if left:
            self._write(rows.drop(*PARTITIONS), "overwrite")
        for day, bucket in touched:
            if bucket not in left:
                self._remove(f"expires_day={day}/bucket={bucket}")

    def _remove(self, folder: str) -> None:
        remove_folder(self.spark, f"{self.root}/{folder}")


def purge_stores(stores: dict[str, CacheStore | None], as_of: datetime) -> dict[str, int]:
    """:meth:`CacheStore.purge` of every table; a missing one (``None``) counts 0."""
    return {name: 0 if store is None else store.purge(as_of) for name, store in stores.items()}


def lifetime(ttl: str) -> timedelta:
    """``"24 hours"`` as a duration."""
    number, unit = ttl.lower().split()
    return timedelta(**{unit if unit.endswith("s") else f"{unit}s": int(number)})
