"""Nearest neighbours of a stated query set by a block matrix join.

Queries and candidates are dealt into tiles of a bounded number of rows; each pair of a query tile and a candidate tile is
one task's work. There, unit vectors are rounded to int8 with a scale each, so a product tile of small integers gives all
cosines up to a known error: ``|error| <= |e_u| + |u'| |e_v|`` for rounding errors ``e``. Pairs whose upper bound does not
reach a query's k-th best so far are done; the others are computed again from the original vectors in double precision
and go through a heap of k a query. The heaps of all tiles are merged by query. Nothing is approximate in the result.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor does a null
``vec_id``; vectors of different length are not compared. Rows that repeat a ``vec_id`` are one row's copies: a query does
not find its own id, and another id is found once, by its best row; of a query id with several vectors the smallest one
asks. Ties go to the smaller ``vec_id``. Other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm import base
from pagequarry.llm.base import written
from pagequarry.llm.vectors import cosines, doubles, lengths, rows_of, usable

#: Rows of a query tile and of a candidate tile; candidates of one product.
QUERY_TILE, TILE, STEP = 4096, 16_384, 1024


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``queries(vec_id, embedding)`` its ``k`` nearest rows of ``vectors``."""
    good = doubles(vectors.filter(usable() & F.col("vec_id").isNotNull()).select("vec_id", "embedding"))
    one = doubles(queries.filter(usable() & F.col("vec_id").isNotNull()).select("vec_id", "embedding")).groupBy("vec_id")
    asked = written(one.agg(F.min("embedding").alias("embedding")))
    tiles, query_tiles = base.parts(good.count(), TILE), base.parts(asked.count(), QUERY_TILE)
    cell = lambda row, col: (row * tiles + col).cast("long").alias("cell")
    size = F.size("embedding").alias("width")
    row, col = F.expr(f"pmod(xxhash64(vec_id), {query_tiles})"), F.expr(f"pmod(xxhash64(vec_id, embedding), {tiles})")
    left = asked.select("vec_id", "embedding", size, row.alias("_r"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("_c")).select("vec_id", "embedding", "width", cell(F.col("_r"), F.col("_c")))
    right = good.select("vec_id", "embedding", size, col.alias("_c"), F.explode(F.sequence(F.lit(0), F.lit(query_tiles - 1))).alias("_r")).select("vec_id", "embedding", "width", cell(F.col("_r"), F.col("_c")))

    def tile(asked: pa.Table, given: pa.Table) -> pa.Table:
        found = []
        for width in set(asked["width"].to_pylist()) if asked.num_rows else ():
            a, b = (t.filter(pc.equal(t["width"], width)) for t in (asked, given))
            if b.num_rows:
                found += best_of(a["vec_id"].to_numpy(), rows_of(a["embedding"]), b["vec_id"].to_numpy(), rows_of(b["embedding"]), k)
        return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()), "vec_id": pa.array([f[1] for f in found], pa.int64()), "score": pa.array([f[2] for f in found], pa.float64())})

    found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(tile, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def rounded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whole numbers from -127 to 127, the scale of each row, the length of what they stand for, and of the error."""
    scale = np.abs(unit).max(axis=1) / 127
    whole = np.rint(unit / scale[:, None])
    near = whole * scale[:, None]
    return whole.astype(np.int8), scale, lengths(near), np.sqrt(((unit - near) ** 2).sum(axis=1))


def best_of(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The ``k`` best of ``vectors`` for each query, as (query, vector, cosine)."""
    q8, qs, ql, qe = rounded(queries / lengths(queries)[:, None])
    # Products of int8 numbers, added in float32: exact while they stay below 2**24.
    wide = np.float32 if 127 * 127 * queries.shape[1] < 1 << 24 else np.float64
    heaps: list[list[tuple[float, int]]] = [[] for _ in query_ids]
    known = [dict() for _ in query_ids]
    floor = np.full(len(query_ids), -2.0)
    left = q8.astype(wide)
    for at in range(0, len(ids), STEP):
        part = vectors[at : at + STEP]
        v8, vs, _, ve = rounded(part / lengths(part)[:, None])
        near = (left @ v8.astype(wide).T).astype(np.float64) * qs[:, None] * vs[None, :]
        slack = qe[:, None] + ql[:, None] * ve[None, :] + 1e-9
        other = query_ids[:, None] != ids[None, at : at + STEP]
        low = np.where(other, near - slack, -3.0)
        # A repeated id may take several of the best places, so a first bound needs distinct ids.
        if len(part) > k and len(np.unique(ids[at : at + STEP])) == len(part):
            floor = np.maximum(floor, np.partition(low, len(part) - k, axis=1)[:, len(part) - k])
        x, y = np.nonzero(other & (near + slack >= floor[:, None]))
        for a in range(0, len(x), 1 << 16):
            p, v = x[a : a + (1 << 16)], y[a : a + (1 << 16)]
            for i, vec, score in zip(p.tolist(), ids[at + v].tolist(), cosines(queries[p], part[v]).tolist(), strict=True):
                heap, seen = heaps[i], known[i]
                if vec in seen:  # a copy of an id that is held: only the better row counts
                    if score > seen[vec]:
                        heap.remove((seen[vec], -vec))
                        heapq.heapify(heap)
                        seen[vec] = score
                        heapq.heappush(heap, (score, -vec))
                elif len(heap) < k:
                    seen[vec] = score
                    heapq.heappush(heap, (score, -vec))
                elif (score, -vec) > heap[0]:
                    gone = heapq.heapreplace(heap, (score, -vec))
                    del seen[-gone[1]]
                    seen[vec] = score
        floor = np.maximum(floor, [h[0][0] if len(h) == k else -2.0 for h in heaps])
    return [(int(q), -vec, score) for q, heap in zip(query_ids, heaps, strict=True) for score, vec in heap]
