"""A join that keeps one hot key, or the missing ones, from landing in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.session import settle

#: Parts that rows without a key are dealt over.
PARTS = 64


def spread_join(left: DataFrame, right: DataFrame, on: list[str], by: str) -> DataFrame:
    """Left join of a possibly skewed ``left`` with a ``right`` that has one row per key.

    ``right`` is written first. Then both sides meet in plain exchanges, of which the adaptive skew join splits any
    partition that a hot key fills; above an aggregate or a window it could not. Rows with a NULL key match nothing and
    are dealt out by a hash of ``by``.
    """
    blank = F.lit(False)
    for key in on:
        blank = blank | F.col(key).isNull()
    part = F.when(blank, F.pmod(F.xxhash64(by), F.lit(PARTS)).cast("int")).otherwise(F.lit(0))
    salted = left.withColumn("_salt", part)
    return salted.join(settle(right).withColumn("_salt", F.lit(0)), [*on, "_salt"], "left").drop("_salt")
