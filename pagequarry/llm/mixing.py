"""Mixing sources to target weights by proportionate-fair scheduling.

Time is a row of slots, a slot takes one block of one source. With weight ``w``, a source's block ``k`` is released at
``floor(k / w)`` and due at ``ceil((k + 1) / w)``. Always taking the released block with the earliest deadline meets every
deadline, so after any number of slots each source that still has blocks is less than one block away from its share.

Weights are whole numbers of ``resolution`` slots, so the schedule repeats after that many slots: only one period is
computed, on the driver, and its size does not depend on the data. A source's blocks then find their slots by
arithmetic. Every row is placed; the slots of a source that has run out stay empty, and the others keep their order and
their proportions to each other. Sources without a weight of their own, and null sources, form one pool with the weight
``rest``.

Within a source, rows are ordered by a hash of ``doc_id``. Numbers along a source are counts of smaller hash buckets plus
a rank inside a bucket, so a source with a third of all rows is as many tasks as it has buckets.

Defined results: repeated rows are placed each, next to each other, and rows that share a ``doc_id`` but differ may change
places from run to run; a null ``doc_id`` comes first in its source; texts do
not matter, also null or empty ones; an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.base import written

#: Slots of a period, rows of a block, rows of a hash bucket (at most 16 times fewer on average).
RESOLUTION, BLOCK_ROWS, BUCKET_ROWS = 1000, 8, 20_000
#: Name of the pool of all sources without a weight.
REST = ""


def quotas(weights: dict[str, float], rest: float, resolution: int = RESOLUTION) -> dict[str, int]:
    """Slots of each source in a period: at least one each, largest remainders first, the sum is the period."""
    shares = {**{k: float(v) for k, v in weights.items()}, REST: float(rest)}
    if any(not v > 0 or math.isinf(v) for v in shares.values()):
        raise ValueError("weights must be positive numbers")
    if len(shares) > resolution:
        raise ValueError("resolution must be at least the number of sources")
    total = sum(shares.values())
    free = resolution - len(shares)
    exact = {k: v / total * resolution for k, v in shares.items()}
    over = {k: max(0.0, x - 1) for k, x in exact.items()}
    scale = free / sum(over.values()) if sum(over.values()) > 0 else 0.0
    out = {k: 1 + math.floor(x * scale + 1e-9) for k, x in over.items()}
    left = sorted(over, key=lambda k: (-(over[k] * scale - math.floor(over[k] * scale + 1e-9)), k))
    for k in left[: resolution - sum(out.values())]:
        out[k] += 1
    return out


def period(quota: dict[str, int]) -> dict[str, list[tuple[int, int, int]]]:
    """Release, deadline and slot of every block of one period, by source."""
    total, names = sum(quota.values()), sorted(quota)
    out: dict[str, list[tuple[int, int, int]]] = {name: [] for name in names}
    for slot in range(total):
        best = None
        for name in names:
            k = len(out[name])
            release, due = k * total // quota[name], -(-(k + 1) * total // quota[name])
            if k < quota[name] and release <= slot and (best is None or due < best[1]):
                best = (name, due, release)
        name, due, release = best
        out[name].append((release, due, slot))
    return out


def place(docs: DataFrame, weights: dict[str, float], rest: float, block_rows: int = BLOCK_ROWS, resolution: int = RESOLUTION) -> DataFrame:
    """``docs`` with ``_pool, _order, _block, _release, _due, _slot`` of each row, in place of columns of these names."""
    docs = docs.drop("_bucket", "_rank", "_offset", "_quota", "_releases", "_dues", "_slots", "_pool", "_block")
    quota = quotas(weights, rest, resolution)
    plan = [(name, quota[name], [b[0] for b in blocks], [b[1] for b in blocks], [b[2] for b in blocks]) for name, blocks in period(quota).items()]
    spark = docs.sparkSession
    plan = spark.createDataFrame(plan, "_pool string, _quota long, _releases array<long>, _dues array<long>, _slots array<long>")
    digits = max(1, math.ceil(math.log(max(1, docs.count() / BUCKET_ROWS), 16)))
    pool = F.when(F.col("source").isin([*weights]), F.col("source")).otherwise(F.lit(REST))
    keyed = docs.withColumns({"_pool": pool, "_order": F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(""))})
    keyed = keyed.withColumn("_bucket", F.substring("_order", 1, digits))
    sizes = written(keyed.groupBy("_pool", "_bucket").agg(F.count("*").alias("_n")))
    before = Window.partitionBy("_pool").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pool", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_pool", "_bucket").orderBy("_order", "doc_id"))
    ranked = keyed.withColumn("_rank", inside - 1).join(written(offsets), ["_pool", "_bucket"]).withColumn("_block", F.expr(f"CAST((_rank + _offset) DIV {block_rows} AS BIGINT)"))
    # The plan has as many entries as a period has slots, whatever the data.
    timed = ranked.join(F.broadcast(plan), "_pool")
    at = F.expr("CAST(_block % _quota AS INT)")
    start = F.expr(f"(_block DIV _quota) * {sum(quota.values())}")
    timed = timed.withColumns({"_release": start + F.get("_releases", at), "_due": start + F.get("_dues", at), "_slot": start + F.get("_slots", at)})
    return timed.drop("_bucket", "_rank", "_offset", "_quota", "_releases", "_dues", "_slots")


def in_order(docs: DataFrame, weights: dict[str, float], rest: float, block_rows: int = BLOCK_ROWS, resolution: int = RESOLUTION) -> DataFrame:
    """The rows of ``docs``, its columns only, in the order of the schedule: ranges of slots, in order inside and across partitions."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source")
    placed = written(place(whole, weights, rest, block_rows, resolution).select("row", "_slot", "_order"))
    return placed.repartitionByRange("_slot", "_order").sortWithinPartitions("_slot", "_order").select("row.*")
