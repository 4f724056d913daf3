"""Near-duplicate documents by MinHash with tensored banding.

A document's set holds its distinct word shingles. :data:`HALF` keys are made for each of two collections, each key from
:data:`EACH` minhashes; a table's key is a pair of one key of either collection. So ``HALF ** 2`` tables of
``2 * EACH`` minhashes a key cost only ``2 * HALF * EACH`` minhashes. At a similarity of 0.8 a pair is missed by all
tables with a chance of 1e-5, at 0.85 of 4e-7.

1. Documents with equal sets are one representative: copies are never compared.
2. Documents that share a first-collection key with another are the only ones whose table keys are made, and only tables'
   buckets with two members or more go on.
3. In each bucket every member is compared with one pivot, the member that meets most others; this joins tight groups
   with as many comparisons as members.
4. What is left in a bucket in different components is compared pairwise, inside tasks and in blocks of a fixed size,
   each pair in the first table that it shares; a longer signature drops pairs that are far from the threshold (a pair at
   it passes with a chance above 1 - 2e-5).
5. Every link is confirmed on full sets; links make components.

Defined results: a document without words, or with a null text, has an empty set and links with nothing; one with fewer
words than a shingle has its whole word sequence as its only shingle. Rows that share a ``doc_id`` are one document with
several texts: what links with any of them is in its class. A null ``doc_id`` takes no part: null component, kept. Texts of
any length are read whole. Other columns are ignored, and stay in :func:`keep_one`; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm import base, text
from pagequarry.llm.base import written
from pagequarry.llm.components import components

#: Keys per collection, minhashes per key, minhashes of the longer signature.
HALF, EACH, LONG = 12, 2, 512
#: Members of a bucket that are compared as one block; rows of one comparing task.
BLOCK, TASK_ROWS = 1000, 20_000

_XOR, _ODD = text.seeds(LONG, 21), text.seeds(LONG, 22) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for low, high in base.runs(offsets):
        cut = offsets[low : high + 1] - offsets[low]
        hashes, _, _, owner = text.byte_words(data[offsets[low] : offsets[high]], cut, lower=True)
        found, at = text.windows(hashes, owner, size)
        bounds = np.searchsorted(owner[at], np.arange(high - low + 1))
        firsts = np.searchsorted(owner, np.arange(high - low + 1))
        for k in range(high - low):
            a, b = firsts[k], firsts[k + 1]
            if b - a >= size:
                yield np.unique(found[bounds[k] : bounds[k + 1]])
            elif b > a:
                whole = np.uint64(b - a)
                for h in hashes[a:b]:
                    whole = whole * np.uint64(text.PRIME) + h
                yield text.mix(np.array([whole]))
            else:
                yield hashes[:0]


def minhashes(sets: list[np.ndarray], n: int) -> np.ndarray:
    """``n`` minhashes of each non-empty set, a row each."""
    every = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    return np.stack([np.minimum.reduceat((every ^ x) * odd, starts) for x, odd in zip(_XOR[:n], _ODD[:n], strict=True)], axis=1)


def _some(sets: list[np.ndarray], most: int = 1 << 18) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Numbers and members of the non-empty sets, in runs of a bounded size."""
    full = np.flatnonzero([len(s) for s in sets])
    bounds = np.concatenate([[0], np.cumsum([len(sets[k]) for k in full])])
    for a, b in base.runs(bounds, most) if len(full) else ():
        yield full[a:b], [sets[k] for k in full[a:b]]


def half_keys(low: np.ndarray) -> np.ndarray:
    """``2 * HALF`` keys of each row of minhashes: the first collection's, then the second's."""
    n = 2 * HALF
    keys = np.zeros((len(low), n), np.uint64)
    for k in range(EACH):
        keys = keys * np.uint64(text.PRIME) + low[:, k * n : (k + 1) * n]
    return text.mix(keys + np.arange(n, dtype=np.uint64))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """``(doc_id, n, low, high, first, second)``: set size, set identity, half keys of both collections."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = base.strings(batch["text"])
            sets = list(shingle_sets(data, offsets, size))
            keys = np.zeros((len(sets), 2 * HALF), np.uint64)
            for at, some in _some(sets):
                keys[at] = half_keys(minhashes(some, 2 * HALF * EACH))
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(k).view(np.int64).reshape(-1)), HALF).cast(pa.list_(pa.int64())) for k in (keys[:, :HALF], keys[:, HALF:])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, _identities(sets)), *lists], names=["doc_id", "n", "low", "high", "first", "second"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, low long, high long, first array<long>, second array<long>")


def _identities(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two sums of each set, by which equal sets are known."""
    low, high = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    for at, some in _some(sets):
        starts = np.concatenate([[0], np.cumsum([len(s) for s in some])[:-1]])
        every = np.concatenate(some)
        low[at], high[at] = np.add.reduceat(every, starts), np.add.reduceat(text.mix(every ^ _XOR[0]), starts)
    return np.array([len(s) for s in sets], dtype=np.int64), low.view(np.int64), high.view(np.int64)


def near_duplicates(docs: DataFrame, threshold: int = 80, size: int = 5) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``; links are ``100 * intersection >= threshold * union``."""
    rows = written(signatures(docs, size))
    identity = ["low", "high", "n"]
    known = rows.filter("doc_id IS NOT NULL AND n > 0")
    reps = written(known.groupBy(*identity).agg(F.min("doc_id").alias("id"), F.first("first").alias("first"), F.first("second").alias("second")))
    members = written(bucket_members(reps))
    sets = written(_sets(docs, members.select("id").distinct(), size))
    near = written(confirmed(written(_pivot_pairs(members)), sets, threshold))
    found = components(near)
    points = reps.select("id", *identity, "first", "second").join(sets.select("id", *identity, "long"), ["id", *identity]).drop("low", "high")
    rest = written(_rest_pairs(members, found, points, threshold))
    more = written(confirmed(rest, sets, threshold))
    if more.head(1):
        found = components(near.union(more))
    # Every row finds its representative, every representative its component.
    of_set = written(reps.select(*identity, "id").join(found, "id", "left").select(*identity, F.coalesce("component", "id").alias("component_id")))
    out = rows.select("doc_id", *identity).join(of_set, identity, "left")
    own = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def bucket_members(reps: DataFrame) -> DataFrame:
    """``(key, a, b, id)`` of every table bucket that has two members or more; ``a`` and ``b`` are the halves of its key."""
    first = reps.select("id", F.explode("first").alias("a"))
    shared = written(first.groupBy("a").agg(F.count("*").alias("_n")).filter("_n > 1").select("a"))
    some = written(first.join(shared, "a").groupBy("id").agg(F.collect_list("a").alias("a")))
    keys = some.join(reps.select("id", "second"), "id").select("id", F.explode("a").alias("a"), "second").select("id", "a", F.explode("second").alias("b"))
    keys = written(keys.select("id", "a", "b", F.xxhash64("a", "b").alias("key")))
    full = written(keys.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key"))
    return keys.join(full, "key").select("key", "a", "b", "id")


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """``(id, n, low, high, shingles, long)`` of the documents named in ``ids``: sorted 64-bit hashes, and a byte of each long minhash.

    An id that occurs with different texts has a row for each of its sets; pairs that name it are confirmed with all of them.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = base.strings(batch["text"])
            sets = list(shingle_sets(data, offsets, size))
            long = np.zeros((len(sets), LONG), np.uint8)
            n, low, high = _identities(sets)
            for at, some in _some(sets):
                long[at] = minhashes(some, LONG).astype(np.uint8)
            packs = (pa.array([r.tobytes() for r in v], pa.binary()) for v in (sets, long))
            yield pa.RecordBatch.from_arrays([batch["id"], *map(pa.array, (n, low, high)), *packs], names=["id", "n", "low", "high", "shingles", "long"])

    wanted = docs.select(F.col("doc_id").alias("id"), "text").join(written(ids), "id", "left_semi")
    return wanted.mapInArrow(run, f"id {kind}, n long, low long, high long, shingles binary, long binary").dropDuplicates(["id", "n", "low", "high"])


def least_agreement(threshold: int) -> int:
    """Places in which the long signatures of a pair at the threshold agree, but for a chance of about 2e-5."""
    share = threshold / 100
    return math.floor(LONG * share - 4.2 * math.sqrt(LONG * share * (1 - share)))


def _pivot_pairs(members: DataFrame) -> DataFrame:
    """``(x, y)``: each member with the pivot of each of its buckets."""
    sizes = members.groupBy("key").agg(F.count("*").alias("size"))
    met = members.join(written(sizes), "key").groupBy("id").agg(F.sum("size").alias("met"))
    ranked = members.join(written(met), "id")
    pivots = written(ranked.groupBy("key").agg(F.min(F.struct((-F.col("met")).alias("_m"), "id")).alias("_best")).select("key", F.col("_best.id").alias("y")))
    return members.join(pivots, "key").filter("id <> y").select(F.col("id").alias("x"), "y").distinct()


def _rest_pairs(members: DataFrame, found: DataFrame, points: DataFrame, threshold: int) -> DataFrame:
    """Pairs of a bucket that are in different components: compared in blocks, each pair in one table only."""
    placed = members.join(found, "id", "left").select("key", "a", "b", "id", F.coalesce("component", "id").alias("component"))
    open_ = placed.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("_l"), F.max("component").alias("_h")).filter("_l < _h").select("key", "size")
    placed = written(placed.join(written(open_), "key"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = placed.withColumn("blocks", blocks).withColumn("mine", F.expr("CAST(pmod(xxhash64(id), blocks) AS INT)"))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    spread = placed.select("key", "a", "b", "id", "component", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    tasks = base.parts(spread.count(), TASK_ROWS)
    spread = spread.join(points, "id")
    spread = spread.withColumn("task", F.expr(f"CAST(pmod(xxhash64(key, i, j), {tasks}) AS INT)"))
    least = least_agreement(threshold)
    kind = points.schema["id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending"), ("id", "ascending")])
        key, left, right, i, j, mine, ids, comp, n = (table[c].to_numpy() for c in ("key", "a", "b", "i", "j", "mine", "id", "component", "n"))
        first, second = (np.array(table[c].combine_chunks().flatten()).reshape(-1, HALF) for c in ("first", "second"))
        long = np.frombuffer(b"".join(table["long"].to_pylist()), np.uint8).reshape(-1, LONG)
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        group = np.cumsum(new)
        out = []
        for step in range(1, int(np.diff(np.append(np.flatnonzero(new), len(key))).max())):
            x = np.flatnonzero(group[:-step] == group[step:])
            y = x + step
            ok = (comp[x] != comp[y]) & ((i[x] == j[x]) | (mine[x] != mine[y])) & (100 * np.minimum(n[x], n[y]) >= threshold * np.maximum(n[x], n[y]))
            x, y = x[ok], y[ok]
            for a in range(0, len(x), 1 << 15):
                p, q = x[a : a + (1 << 15)], y[a : a + (1 << 15)]
                # The first half keys that both have name the one table in which the pair is looked at.
                one, two = (first[p] == first[q]).argmax(axis=1), (second[p] == second[q]).argmax(axis=1)
                here = (first[p, one] == left[p]) & (second[p, two] == right[p])
                p, q = p[here], q[here]
                near = (long[p] == long[q]).sum(axis=1) >= least
                p, q = p[near], q[near]
                out.append(np.stack([ids[p], ids[q]]))
        pairs = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((2, 0), ids.dtype)
        return pa.table({"x": pairs[0], "y": pairs[1]})

    return spread.drop("blocks").groupBy("task").applyInArrow(run, f"x {kind}, y {kind}")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """``(a, b)`` of the pairs whose full sets are similar enough."""
    sets = sets.select("id", "shingles")
    both = pairs.join(sets.toDF("x", "sx"), "x").join(sets.toDF("y", "sy"), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for one, two in zip(batch["sx"], batch["sy"], strict=True):
                a, b = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(100 * common >= threshold * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch["x"], batch["y"]], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, f"a {pairs.schema['x'].dataType.simpleString()}, b {pairs.schema['x'].dataType.simpleString()}")


def keep_one(docs: DataFrame, threshold: int = 80, size: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, without those whose class has a smaller ``doc_id``."""
    gone = written(near_duplicates(docs, threshold, size).filter("NOT kept").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
