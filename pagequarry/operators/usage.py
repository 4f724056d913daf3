"""Usage metering: quota, resets, increments, audit log, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry import rules


def email_domain(email: Column) -> Column:
    """Lower-case part after the first ``@`` (up to the next), NULL without one."""
    return F.nullif(F.get(F.split(F.lower(email), "@", -1), F.lit(1)), F.lit(""))


def is_unlimited(email: Column, domains: Sequence[str]) -> Column:
    """Does the e-mail belong to a domain without a limit? ``domains`` is a configured list."""
    wanted = [d.strip().lower() for d in domains if d.strip()]
    return F.coalesce(email_domain(email).isin(*wanted) if wanted else F.lit(False), F.lit(False))


def next_month(as_of: Column) -> Column:
    """First moment of the next month."""
    return F.add_months(F.trunc(as_of.cast("date"), "MM"), 1).cast("timestamp_ntz")


def check_usage(users: DataFrame, profiles: DataFrame, as_of: Column, domains: Sequence[str]) -> DataFrame:
    """``(user_id, allowed, remaining, reason, unlimited)`` per user; ``remaining`` is NULL when unlimited."""
    joined = users.join(profiles.withColumn("_known", F.lit(True)), "user_id", "left")
    free = F.lit(rules.FREE_PER_MONTH)
    missing = F.col("_known").isNull()
    unlimited = is_unlimited(F.col("email"), domains)
    due = F.coalesce(as_of > F.col("free_analyses_reset_at"), F.lit(False))
    left = F.greatest(F.lit(0), free - F.coalesce("free_analyses_used", F.lit(0)))
    remaining = F.when(missing, F.lit(0)).when(unlimited, F.lit(None)).when(due, free).otherwise(left)
    return joined.select(
        "user_id",
        (~missing & (unlimited | due | (left > 0))).alias("allowed"),
        remaining.cast("int").alias("remaining"),
        F.when(missing, F.lit(rules.REASON_NO_PROFILE))
        .when(~unlimited & ~due & (left <= 0), F.lit(rules.REASON_LIMIT))
        .alias("reason"),
        (~missing & unlimited).alias("unlimited"),
    )


def quota_replay(log: DataFrame, limit: int = rules.FREE_PER_MONTH) -> DataFrame:
    """The log with ``month`` and ``allowed``: the first ``limit`` runs per user and calendar month.

    ``log`` has ``user_id``, ``ts`` and a unique ``event_id``. The admitted runs come from a row number that Spark
    limits per task before its shuffle; every run then learns its verdict by a join on its own id, which spreads a
    heavy user over all tasks.
    """
    dated = log.withColumn("month", F.trunc(F.col("ts").cast("date"), "MM"))
    order = Window.partitionBy("user_id", "month").orderBy("ts", "event_id")
    admitted = (
        dated.select("user_id", "month", "ts", "event_id")
        .withColumn("_rn", F.row_number().over(order))
        .filter(F.col("_rn") <= limit)
        .select("event_id", F.lit(True).alias("allowed"))
    )
    return dated.join(admitted, "event_id", "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def monthly_reset(profiles: DataFrame, as_of: Column) -> DataFrame:
    """Profiles past their reset date start again at 0 until the first of the next month."""
    due = F.coalesce(as_of > F.col("free_analyses_reset_at"), F.lit(False))
    return profiles.withColumns(
        {
            "free_analyses_used": F.when(due, F.lit(0)).otherwise(F.col("free_analyses_used")),
            "free_analyses_reset_at": F.when(due, next_month(as_of)).otherwise(F.col("free_analyses_reset_at")),
        }
    )


def increment_usage(profiles: DataFrame, runs: DataFrame, domains: Sequence[str]) -> DataFrame:
    """``free_analyses_used`` plus the user's runs; unlimited users stay as they are."""
    counted = runs.groupBy("user_id").agg(F.count("*").cast("int").alias("_runs"))
    added = F.when(is_unlimited(F.col("email"), domains), F.lit(0)).otherwise(F.coalesce("_runs", F.lit(0)))
    return (
        profiles.join(counted, "user_id", "left")
        .withColumn("free_analyses_used", (F.coalesce("free_analyses_used", F.lit(0)) + added).cast("int"))
        .select(*profiles.columns)
    )


def insert_profiles(profiles: DataFrame, signups: DataFrame, as_of: Column) -> DataFrame:
    """``profiles`` with a new one for each user of ``signups(user_id, email, signed_up_at)`` that has none yet.

    A new profile starts at 0 until the first of the next month. An existing one stays as it is, also on a repeated sign-up;
    of several sign-ups of a new user the first counts. Sign-ups without a user are dropped. Minima are combined before the
    shuffle.
    """
    first = signups.filter("user_id IS NOT NULL").groupBy("user_id").agg(F.min_by("email", F.struct("signed_up_at", "email")).alias("email"))
    new = first.join(profiles.select("user_id"), "user_id", "left_anti")
    kinds = {f.name: f.dataType for f in profiles.schema}
    values = {"user_id": F.col("user_id"), "email": F.col("email"), "free_analyses_used": F.lit(0), "free_analyses_reset_at": next_month(as_of)}
    return profiles.unionByName(new.select(*[values.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in profiles.columns]))


def log_rows(runs: DataFrame) -> DataFrame:
    """Audit rows with defaults and their month; runs without a type or a key source are dropped."""
    for name in ("analysis_type", "key_source"):
        runs = runs.filter(F.coalesce(F.col(name), F.lit("")) != "")
    return runs.select(
        "user_id",
        "url",
        "analysis_type",
        "key_source",
        F.coalesce("entities_found", F.lit(0)).cast("int").alias("entities_found"),
        F.coalesce("processing_time_ms", F.lit(0)).cast("int").alias("processing_time_ms"),
        "created_at",
        F.trunc(F.col("created_at").cast("date"), "MM").alias("month"),
    )


def append_log(runs: DataFrame, path: str) -> None:
    """Append audit rows to the log, one folder per month."""
    log_rows(runs).write.mode("append").partitionBy("month").parquet(path)


def usage_report(log: DataFrame) -> DataFrame:
    """Runs, entities and time per month, analysis type and key source, with subtotals (NULL keys)."""
    return log.rollup("month", "analysis_type", "key_source").agg(
        F.count("*").alias("runs"),
        F.sum("entities_found").alias("entities"),
        F.sum("processing_time_ms").alias("total_ms"),
    )


def user_report(log: DataFrame) -> DataFrame:
    """Runs, entities and time per user and month."""
    return log.groupBy("user_id", "month").agg(
        F.count("*").alias("runs"), F.sum("entities_found").alias("entities"), F.sum("processing_time_ms").alias("total_ms")
    )
