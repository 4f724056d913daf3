"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation is learned (principal axes, then alternating between the nearest corners of a cube and the best rotation
towards them) so that the signs of a rotated unit vector are balanced bits. The coordinates are cut into chunks of up to
16, one table each, keyed by the first bits of the chunk. A vector is stored under its own bits and looks under all bits
that a linked vector can have.

That set is exact, not sampled. Unit vectors with cosine ``c`` are ``D2 = 2 - 2c`` apart (squared), a rotation keeps that,
so some chunk of ``m`` has at most ``D2 / m`` of it. There, bits that differ lie on both sides of zero, so their squared
coordinates sum to at most ``D2 / (2m)`` in one of the two vectors. That vector looks under the other's bits if it tries
all flips up to this sum. So recall is 1 for any data, whatever rotation was learned; the rotation only sets how few
candidates there are. Of what a vector finds, only pairs whose chunks are at most ``D2 / m`` apart are ranked again by the
cosine of the original vectors, each pair in one table only.

Equal vectors are one representative with a count. Neither flips nor pairs leave a task: the vectors of a label and length
are dealt into blocks, each pair of blocks meets in one task, and the task keeps the tables of its vectors in memory and
returns a row for each vector with its links counted and the vector it hangs on. A vector of a label with ``b`` blocks
goes to ``b`` tasks; the tasks are run in passes that each ship a bounded multiple of the vectors, so the disk follows the
vectors and not the flips or candidates.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows with a null label, link with
nothing (0 links, own component, kept). Rows that repeat a ``vec_id`` count as vectors of their own when counting links. A
null ``vec_id`` takes no part: null component, kept. Other columns are ignored; an empty table gives an empty result. Equal
vectors of a label are told by two 64-bit hashes when results go back to their rows. Rotations are learned from a bounded
sample of vectors; the bound is a parameter.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm import base
from pagequarry.llm.base import written
from pagequarry.llm.components import components
from pagequarry.llm.vectors import cosines, doubles, lengths, rows_of, usable

#: Vectors that rotations are learned from, rounds of learning, coordinates of a table.
SAMPLE, ROUNDS, CHUNK = 20_000, 30, 16
#: Vectors and bytes of a block, rows of a task that takes several small labels, copies of the vectors that one pass ships.
BLOCK, BLOCK_BYTES, TASK_ROWS, PASS = 1 << 17, 24 << 20, 20_000, 2
#: Squared coordinates are whole numbers of this fraction, so that all steps add them alike; room for rounding in squared distances.
GRAIN, SLACK = float(1 << 26), 1e-6
#: Vectors whose flips are made at once, flips that are dealt to cells at once, distances of one matrix product.
STEP, PROBES, TILE = 2048, 1 << 20, 1 << 20
#: Vectors of a group that are compared without tables.
FEW = 64
#: What a flip and a cell cost against one distance.
FLIP_COST, CELL_COST = 80, 15_000


def learn(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and rotation for unit vectors."""
    mean = unit.mean(axis=0)
    _, axes = np.linalg.eigh((unit - mean).T @ (unit - mean))
    turned = (unit - mean) @ axes[:, ::-1]
    rotation = np.linalg.qr(np.random.default_rng(3).normal(size=(unit.shape[1],) * 2))[0]
    for _ in range(ROUNDS):
        u, _, v = np.linalg.svd(np.where(turned @ rotation >= 0, 1.0, -1.0).T @ turned)
        rotation = (u @ v).T
    return mean, axes[:, ::-1] @ rotation


def rotations(vectors: DataFrame, sample: int = SAMPLE) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Mean and rotation for each vector length in a bounded sample."""
    rows = vectors.select("embedding", F.size("embedding").alias("width")).orderBy(F.xxhash64("embedding")).limit(sample).toArrow()
    out = {}
    for width in set(rows["width"].to_pylist()):
        x = rows_of(rows.filter(pa.array([w == width for w in rows["width"].to_pylist()]))["embedding"])
        out[width] = learn(x / lengths(x)[:, None])
    return out


def turned(x: np.ndarray, model: dict[int, tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The chunks of rotated unit vectors; a task needs their coordinates only to agree with themselves, so single precision does."""
    mean, rotation = model.get(x.shape[1], (np.zeros(x.shape[1]), np.eye(x.shape[1])))
    out = [np.empty((len(x), min(CHUNK, x.shape[1] - t * CHUNK)), np.float32) for t in range(chunks(x.shape[1]))]
    for a in range(0, len(x), 8192):
        some = x[a : a + 8192].astype(np.float64)
        some = (some / lengths(some)[:, None] - mean) @ rotation
        for t, part in enumerate(out):
            part[a : a + 8192] = some[:, t * CHUNK : (t + 1) * CHUNK]
    return out


def grains(coordinates: np.ndarray) -> np.ndarray:
    """Squared coordinates, rounded down."""
    return (coordinates * coordinates * np.float32(GRAIN)).astype(np.int32)


def budget(least: float, width: int) -> int:
    """What flipped bits of one chunk may add up to, in grains."""
    return math.ceil(((2 - 2 * least) / (2 * chunks(width)) + SLACK) * GRAIN)


def chunks(width: int) -> int:
    return -(-width // CHUNK)


def flips(energy: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and mask of every set of bits whose energies add up to ``most`` or less, the empty set included."""
    row, mask, left = np.arange(len(energy), dtype=np.int32), np.zeros(len(energy), np.int32), np.full(len(energy), most, np.int32)
    for k in range(energy.shape[1]):
        rest = left - energy[:, k].astype(np.int32).take(row)
        ok = np.flatnonzero(rest >= 0)
        row, mask, left = np.concatenate([row, row[ok]]), np.concatenate([mask, mask[ok] | np.int32(1 << k)]), np.concatenate([left, rest[ok]])
    return row, mask


def key_bits(energy: np.ndarray, most: int, lookers: int, owners: int) -> int:
    """How many bits of a chunk make the cheapest keys, by the flips of a few vectors."""
    some = energy[:: max(1, len(energy) // 256)]
    costs = []
    for k in range(energy.shape[1] + 1):
        n = len(flips(some[:, :k], most)[0]) / max(1, len(some))
        costs.append(n * (FLIP_COST + owners / 2**k) + CELL_COST * 2**k / max(1, lookers))
        if n > 256 or costs[-1] > 4 * min(costs):
            break
    return int(np.argmin(costs))


def links(vectors: DataFrame, least: float = 0.98, sample: int = SAMPLE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of each row of ``vectors(vec_id, embedding, label)``."""
    rows = vectors.select("vec_id", "label", "embedding")
    single = rows.schema["embedding"].dataType.simpleString() == "array<float>"
    rows = rows if single else doubles(rows)
    rows = rows.withColumn("_good", usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    same = [F.xxhash64("label", "embedding").alias("h"), F.xxhash64("embedding", "label").alias("g")]
    reps = rows.filter("_good").groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    reps = written(reps.select(*same, "id", "copies", F.xxhash64("label").alias("label_hash"), F.size("embedding").alias("width"), "embedding"))
    model = rotations(reps, sample)
    kind = reps.schema["id"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            got = _compared(*group, model, least)
            if len(got[0]):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in got], names=["id", "hangs_on", "n"])

    dealt, passes, tasks = _dealt(reps, 4 if single else 8)
    counted = []
    for k in range(passes):
        some = dealt.filter(F.expr(f"pmod(xxhash64(task), {passes}) = {k}")).repartition(tasks, "task")
        counted.append(written(some.groupBy("task").applyInArrow(compare, f"id {kind}, hangs_on {kind}, n long")))
    counted = functools.reduce(DataFrame.union, counted)
    found = components(counted.select(F.col("id").alias("a"), F.col("hangs_on").alias("b")))
    sums = counted.groupBy("id").agg(F.sum("n").alias("n"))
    of_rep = reps.select("h", "g", "id", "copies").join(sums, "id", "left").join(found, "id", "left")
    of_rep = written(of_rep.select("h", "g", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("_n"), F.coalesce("component", "id").alias("_component")))
    placed = rows.filter("_good").select("vec_id", *same).join(of_rep, ["h", "g"], "left").select("vec_id", "_n", "_component")
    alone = rows.filter("NOT _good").select("vec_id", F.lit(0).cast("long").alias("_n"), F.col("vec_id").alias("_component"))
    return placed.union(alone).select("vec_id", F.col("_n").alias("n_links"), F.col("_component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("_component"), F.lit(True)).alias("kept"))


def _dealt(reps: DataFrame, item: int) -> tuple[DataFrame, int, int]:
    """A row for each vector and task it goes to, the passes that the tasks are run in, and the partitions of a pass.

    A label with more vectors than a task takes is cut into blocks, and each pair of its blocks is a task; others share tasks.
    """
    limit = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES) / (F.col("width") * item))))
    sizes = written(reps.groupBy("label_hash", "width").count().withColumn("block", limit).withColumn("task", F.least("block", F.lit(TASK_ROWS))))
    large = sizes.filter("count > task").selectExpr("label_hash", "width", "CAST(ceil(count / block) AS INT) AS blocks", "count").collect()
    total, small = sizes.agg(F.sum("count"), F.sum(F.expr("IF(count > task, 0, count / task)"))).first()
    small = max(1, math.ceil(small or 0))
    shipped = (total or 0) + sum(r["count"] * (r["blocks"] - 1) for r in large)
    passes = base.parts(shipped, PASS * max(1, total or 0))
    tasks = base.parts(small + sum(r["blocks"] * (r["blocks"] + 1) // 2 for r in large), passes)
    blocks = reps.sparkSession.createDataFrame([(r["label_hash"], r["width"], r["blocks"]) for r in large], "label_hash long, width int, blocks int")
    dealt = reps.join(F.broadcast(blocks), ["label_hash", "width"], "left")
    dealt = dealt.withColumn("mine", F.expr("CAST(coalesce(pmod(xxhash64(h), blocks), 0) AS INT)")).withColumn("with", F.explode(F.expr("sequence(0, coalesce(blocks, 1) - 1)")))
    dealt = dealt.withColumn("i", F.least("mine", "with")).withColumn("j", F.greatest("mine", "with"))
    task = f"IF(blocks IS NULL, pmod(xxhash64(label_hash, width), {small}), xxhash64(label_hash, width, i, j))"
    return dealt.select(F.expr(task).alias("task"), "label_hash", "width", "i", "j", "mine", "id", "copies", "embedding"), passes, 2 * tasks


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Vectors, number of the group, side (0: of a block alone, 1 or 2: of a pair of blocks), ids and copies: one large group (a pair of blocks) at a time, or all small ones of a length."""
    names = ["label_hash", "width", "i", "j", "mine", "id", "copies"]
    # Vectors are copied into one array that grows in place, so that a task holds them once.
    columns, values, held = [[] for _ in names], None, 0
    for batch in batches:
        for column, name in zip(columns, names, strict=True):
            column.append(np.array(batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)))
        some = batch.column(batch.schema.get_field_index("embedding")).flatten().to_numpy(zero_copy_only=False)
        values = np.empty(0, some.dtype) if values is None else values
        if held + len(some) > len(values):
            values.resize(max(held + len(some), len(values) * 5 // 4), refcheck=False)
        values[held : held + len(some)] = some
        held += len(some)
    columns, values = [np.concatenate(c) for c in columns], values[:held]
    widths = columns[1]
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        x = (values if len(at) == len(widths) else values[np.repeat(widths == width, widths)]).reshape(-1, width)
        label, _, i, j, mine, ids, copies = (c[at] for c in columns)
        order = np.lexsort((j, i, label))
        side = np.where(i == j, 0, np.where(mine == i, 1, 2))
        new = np.concatenate([[True], np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in (label, i, j)])])
        sizes = np.diff(np.append(np.flatnonzero(new), len(order)))
        group, size = np.cumsum(new) - 1, np.repeat(sizes, sizes)
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        large = [order[cuts[k] : cuts[k + 1]] for k in np.flatnonzero(sizes > FEW)]
        for some, number in [(order[size <= FEW], group[size <= FEW]), *((r, np.zeros(len(r), np.int64)) for r in large)]:
            if len(some) == len(x) and len(large) == 1:
                yield x, number, side, ids, copies
            elif len(some):
                yield x[some], number, side[some], ids[some], copies[some]


def _all_pairs(group: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of small groups: rows of a group stand together."""
    for step in range(1, int(np.bincount(group - group[0]).max())):
        p = np.flatnonzero((group[:-step] == group[step:]) & ((side[:-step] == 0) | (side[:-step] != side[step:])))
        yield p, p + step


class _Tables:
    """The tables of the vectors of one task: a block, whose vectors look in it, or two, whose vectors look in the other."""

    def __init__(self, x: np.ndarray, side: np.ndarray, model: dict[int, tuple[np.ndarray, np.ndarray]], least: float) -> None:
        width, (alone, first, second) = x.shape[1], (np.flatnonzero(side == k) for k in range(3))
        self.sides = [(alone, alone)] if len(alone) else [(first, second), (second, first)]
        self.parts, self.most, self.far = turned(x, model), budget(least, width), 2 - 2 * least
        self.apart = self.far / chunks(width) + SLACK
        owners, lookers = max(len(b) for _, b in self.sides), sum(len(a) for a, _ in self.sides)
        self.bits = [key_bits(grains(part[:: max(1, len(x) // 256)]), self.most, lookers, owners) for part in self.parts]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Every pair that can be linked, once, and few others."""
        for t in range(len(self.bits)):
            for lookers, owners in self.sides:
                for p, q in _gathered(self.candidates(t, lookers, owners)):
                    # What the first table finds is most of a dense group, and needs one chunk only.
                    ok = (p != q) & self.counts(0, p, q) if t == 0 else ~self.found(0, p, q)[0]
                    p, q = p[ok], q[ok]
                    near = sum(((part.take(p, axis=0) - part.take(q, axis=0)) ** 2).sum(axis=1) for part in self.parts) <= self.far + 20 * SLACK
                    p, q = p[near], q[near]
                    ok = self.counts(t, p, q) if t else slice(None)
                    yield p[ok], q[ok]

    def candidates(self, t: int, lookers: np.ndarray, owners: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs whose chunks are near, of a looker and an owner under bits where it looks."""
        part, k = self.parts[t], self.bits[t]
        energy, codes = grains(part[:, :k]), ((part[:, :k] >= 0) @ (1 << np.arange(k, dtype=np.int32))).astype(np.uint16)
        owners = owners[np.argsort(codes[owners], kind="stable")]
        starts = np.searchsorted(codes[owners], np.arange(2**k + 1))
        squares, ones = (part * part).sum(axis=1, keepdims=True), np.ones((len(part), 1), np.float32)
        of_looker = np.concatenate([part, squares, ones], axis=1)
        of_owner = np.concatenate([-2 * part[owners], ones[owners], squares[owners]], axis=1)
        limit = np.float32(self.apart + 20 * SLACK)
        rows, cells, held = [], [], 0
        for a in range(0, len(lookers), STEP):
            some = lookers[a : a + STEP]
            row, mask = flips(energy.take(some, axis=0), self.most)
            rows.append(some.take(row).astype(np.int32))
            cells.append(codes.take(some).take(row) ^ mask.astype(np.uint16))
            held += len(row)
            if held < PROBES and a + STEP < len(lookers):
                continue
            cell = np.concatenate(cells)
            row = np.concatenate(rows).take(np.argsort(cell, kind="stable"))
            ends = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=2**k))])
            rows, cells, held = [], [], 0
            for c in np.flatnonzero((ends[1:] > ends[:-1]) & (starts[1:] > starts[:-1])):
                for b in range(starts[c], starts[c + 1], 4096):
                    mine = np.ascontiguousarray(of_owner[b : min(b + 4096, starts[c + 1])].T)
                    step = max(1, TILE // mine.shape[1])
                    for d in range(ends[c], ends[c + 1], step):
                        who = row[d : min(d + step, ends[c + 1])]
                        near = np.flatnonzero((of_looker.take(who, axis=0) @ mine).ravel() <= limit)
                        if len(near):
                            yield who[near // mine.shape[1]], owners[b + near % mine.shape[1]]

    def found(self, t: int, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether table ``t`` finds each pair, and whether ``p`` finds it there by looking; every sum is the same in any order of rows."""
        a, b, k = self.parts[t].take(p, axis=0), self.parts[t].take(q, axis=0), self.bits[t]
        apart = functools.reduce(np.add, ((a - b) ** 2).T)
        flipped = (a[:, :k] >= 0) != (b[:, :k] >= 0)
        by_p, by_q = ((grains(v[:, :k]) * flipped).sum(axis=1) <= self.most for v in (a, b))
        return (by_p | by_q) & (apart <= np.float32(self.apart)), by_p

    def counts(self, t: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether the pair, not found by the first table if ``t`` is another, counts where ``p`` looks in table ``t``: its first, and there where the first row looks, if it can, else where the second does."""
        low, high = np.minimum(p, q), np.maximum(p, q)
        ok, by_low = self.found(t, low, high)
        ok &= np.where(by_low, low, high) == p
        for s in range(1, t):
            at = np.flatnonzero(ok)
            ok[at] = ~self.found(s, low[at], high[at])[0]
        return ok


def _gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]], most: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, about ``most`` at a time."""
    held, n = [], 0
    for p, q in pairs:
        for a in range(0, len(p), most):
            held.append((p[a : a + most], q[a : a + most]))
            n += len(held[-1][0])
            if n >= most:
                yield tuple(np.concatenate(v) for v in zip(*held, strict=True))
                held, n = [], 0
    if held:
        yield tuple(np.concatenate(v) for v in zip(*held, strict=True))


def _compared(
    x: np.ndarray, group: np.ndarray, side: np.ndarray, ids: np.ndarray, copies: np.ndarray, model: dict[int, tuple[np.ndarray, np.ndarray]], least: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, the id each hangs on, and how many vectors each was linked with, for a pair of blocks, within one, or within each of many small groups."""
    names, place = np.unique(ids, return_inverse=True)
    sums, roots = np.zeros(len(names), np.int64), np.arange(len(names))

    def root(k: int) -> int:
        while roots[k] != k:
            roots[k] = roots[roots[k]]
            k = roots[k]
        return k

    def count(p: np.ndarray, q: np.ndarray) -> None:
        near = [cosines(*(x.take(v[a : a + 4096], axis=0).astype(np.float64) for v in (p, q))) >= least for a in range(0, len(p), 4096)]
        if not near or not (near := np.concatenate(near)).any():
            return
        p, q = p[near], q[near]
        np.add.at(sums, place[p], copies[q])
        np.add.at(sums, place[q], copies[p])
        while (roots != roots[roots]).any():
            roots[:] = roots[roots]
        pairs = np.sort(np.stack([roots[place[p]], roots[place[q]]], axis=1), axis=1)
        for u, v in np.unique(pairs[pairs[:, 0] < pairs[:, 1]], axis=0).tolist():
            u, v = root(u), root(v)
            roots[max(u, v)] = min(u, v)

    if len(x) <= FEW or group[-1] > group[0]:
        pairs = _all_pairs(group, side)
    else:
        pairs = _Tables(x, side, model, least).pairs()
    for p, q in pairs:
        different = ids[p] != ids[q]
        count(p[different], q[different])
    linked = np.flatnonzero(sums)
    return names[linked], names[[root(k) for k in linked]] if len(linked) else names[:0], sums[linked]
