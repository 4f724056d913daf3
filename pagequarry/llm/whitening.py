"""Whitening of embeddings by shifted CholeskyQR.

Entries become whole numbers ``x = floor(256 * c)``. The fit list holds each distinct vector once; its count and sums are
exact. Centred rows ``x - S/n`` are orthogonalised without ever being stored: each pass over the fit list solves the
triangular factors found so far row by row, adds up one Gram matrix a task, and a Cholesky factor of the sum is the next
triangle. Where that matrix is close to singular, a shift of rounding size is added first, so the factor exists, and a
later pass takes the shift out again. When the rows are orthonormal, the product of the factors is R of the centred rows,
and the singular vectors of the small R are the components, with no squared condition number on the way. One more pass
measures how far the whitened rows are from the identity.

The driver holds matrices of ``width x width`` only, one set for each width that occurs. Tasks hold one batch and one such
matrix. Gram matrices are added row by row in two levels, so no task reads more than its share.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries are left out; other rows are given
each, repeats too, and a null ``vec_id`` stays null. Vectors of one length are fitted together, apart from those of
another. Components without variance do not exist: a table of equal vectors, or an empty one, gives an empty result, and
a width with fewer dimensions or distinct vectors gives fewer components. Entries beyond 64-bit integers end at their
limits; a ``deviation`` beyond them is null. Of equal eigenvalues any orthonormal components are taken, the same for all
rows; each component's largest entry is positive. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.base import packed, written

#: Rows solved at a time in a task.
STEP = 4096
#: Passes at most; three to five are usual.
PASSES = 12
#: Largest entry of Gram matrix minus identity at which the rows count as orthonormal; more for very many rows, whose sums round more.
ORTHONORMAL = 1e-12
EPS = float(np.finfo(float).eps)
#: Numbers below this stay exact when they are added in 64 bits.
SAFE = 1 << 62


def usable(column: str = "embedding") -> Column:
    """Whether a vector takes part: not null, not empty, only finite entries."""
    return F.coalesce((F.size(column) > 0) & F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def whole(vectors: DataFrame) -> DataFrame:
    """``(vec_id, x)``: the vectors that take part, as whole numbers."""
    return vectors.filter(usable()).select("vec_id", F.transform("embedding", lambda c: F.floor(F.lit(256.0) * c.cast("double"))).alias("x"))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row numbers, matrix)`` for each length of the lists, up to ``STEP`` rows at a time."""
    sizes = np.diff(np.asarray(column.offsets))
    values = np.asarray(column.flatten(), dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    for width in np.unique(sizes):
        at = np.flatnonzero(sizes == width)
        for k in range(0, len(at), STEP):
            some = at[k : k + STEP]
            yield some, values[starts[some][:, None] + np.arange(width)]


@dataclass
class Fit:
    """What is known of the vectors of one width: count and sums, triangular factors, components, and the whitened rows' error."""

    n: int
    sums: list[int]
    factors: list[np.ndarray]
    left: np.ndarray | None = None  # the last Gram matrix: the identity, but for directions without variance
    components: np.ndarray | None = None  # a column each
    eigenvalues: np.ndarray | None = None
    total: float = 0.0
    error: float = 0.0

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``n * x - S`` exactly (64-bit, or Python numbers where they are too large), and ``x - S/n``."""
        top = int(np.abs(x.astype(np.float64)).max(initial=0)) + 1
        fits = self.n * top + max(map(abs, self.sums)) < SAFE
        exact = self.n * (x if fits else x.astype(object)) - np.array(self.sums, dtype=np.int64 if fits else object)
        return exact, (exact / self.n).astype(np.float64)

    def solved(self, x: np.ndarray) -> np.ndarray:
        """The centred rows after a solve with each factor."""
        rows = self.centred(x)[1]
        for r in self.factors:
            rows = solve(rows, r)
        return rows

    def whitened(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        exact, rows = self.centred(x)
        return exact, (rows @ self.components) / np.sqrt(self.eigenvalues)


def solve(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``rows @ inverse(r)`` for an upper triangle ``r``, by substitution column after column."""
    out = np.empty_like(rows)
    for j in range(len(r)):
        out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def next_factor(gram: np.ndarray, n: int) -> np.ndarray:
    """The upper Cholesky factor of ``gram``, shifted where it is not safely positive definite."""
    low, top = np.linalg.eigvalsh(gram)[[0, -1]]
    if low > 1e-3 * top:
        return np.linalg.cholesky(gram).T
    width = len(gram)
    shift = 11 * (width * np.sqrt(n) + width * (width + 1)) * EPS / 2 * max(top, np.finfo(float).tiny)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(width)).T
        except np.linalg.LinAlgError:
            shift *= 16


def sums_of(fit: DataFrame) -> dict[int, Fit]:
    """Count and exact sums of each width. Tasks add halves of 32 bits, which cannot overflow; the driver puts them together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}
        for batch in batches:
            for _, x in matrices(batch["x"]):
                count, high, low = kept.setdefault(x.shape[1], [0, np.zeros(x.shape[1], np.int64), np.zeros(x.shape[1], np.int64)])
                kept[x.shape[1]] = [count + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)]
        for width, (count, high, low) in kept.items():
            yield pa.RecordBatch.from_pydict({"width": [width], "n": [count], "high": [high.tolist()], "low": [low.tolist()]}, schema=pa.schema([("width", pa.int32()), ("n", pa.int64()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))]))

    part = fit.mapInArrow(run, "width int, n long, high array<long>, low array<long>")
    each = part.select("width", "n", F.posexplode(F.arrays_zip("high", "low")).alias("pos", "half"))
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    rows = each.groupBy("width", "pos").agg(total("n").alias("n"), total("half.high").alias("high"), total("half.low").alias("low")).collect()
    out: dict[int, Fit] = {}
    for r in sorted(rows, key=lambda r: (r["width"], r["pos"])):
        out.setdefault(r["width"], Fit(int(r["n"]), [], [])).sums.append((int(r["high"]) << 32) + int(r["low"]))
    return out


def grams(fit: DataFrame, fits: dict[int, Fit], whitened: bool = False) -> dict[int, np.ndarray]:
    """The Gram matrix of the solved (or whitened, with a column of ones) rows of each width, in one pass over the fit list."""
    shared = fit.sparkSession.sparkContext.broadcast(fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in matrices(batch["x"]):
                known = shared.value[x.shape[1]]
                if whitened:
                    if known.components is None:
                        continue
                    rows = np.hstack([np.ones((len(x), 1)), known.whitened(x)[1]])
                else:
                    rows = known.solved(x)
                kept[x.shape[1]] = kept.get(x.shape[1], 0.0) + rows.T @ rows
        task = TaskContext.get().partitionId()
        for width, gram in kept.items():
            yield pa.RecordBatch.from_pydict({"width": [width] * len(gram), "line": list(range(len(gram))), "task": [task] * len(gram), "sums": [packed(g) for g in gram]}, schema=pa.schema([("width", pa.int32()), ("line", pa.int32()), ("task", pa.int32()), ("sums", pa.binary())]))

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")  # one order of adding, so one result
        total = sum(np.frombuffer(s.as_py()) for s in table["sums"])
        return table.slice(0, 1).set_column(table.schema.get_field_index("sums"), "sums", pa.array([packed(total)], pa.binary()))

    schema = "width int, line int, task int, sums binary"
    part = fit.mapInArrow(run, schema)
    some = part.groupBy("width", "line", (F.col("task") % 256).alias("share")).applyInArrow(lambda t: add(t.select(["width", "line", "task", "sums"])), schema)
    rows = some.groupBy("width", "line").applyInArrow(add, schema).collect()
    shared.unpersist()
    out: dict[int, np.ndarray] = {}
    for width in {r["width"] for r in rows}:
        lines = sorted((r["line"], r["sums"]) for r in rows if r["width"] == width)
        out[width] = np.array([np.frombuffer(s) for _, s in lines])
    return out


def fitted(fit: DataFrame, components: int) -> dict[int, Fit]:
    """Components of each width from the fit list ``(x)``."""
    fits = sums_of(fit)
    open_ = dict(fits)
    for _ in range(PASSES):
        if not open_:
            break
        for width, gram in grams(fit.filter(F.size("x").isin(list(open_))), open_).items():
            known = open_[width]
            known.left = gram
            if np.abs(gram - np.diag((np.diag(gram) > 0.5).astype(float))).max() <= max(ORTHONORMAL, 8 * EPS * np.sqrt(known.n)):
                del open_[width]
            elif len(known.factors) < PASSES - 1:
                known.factors.append(next_factor(gram, known.n))
    for width, known in fits.items():
        values, turned = np.linalg.eigh(known.left)
        r = (turned * np.sqrt(np.maximum(values, 0))) @ turned.T
        for factor in reversed(known.factors):
            r = r @ factor
        _, sizes, across = np.linalg.svd(r)
        rank = int((sizes > sizes[0] * max(width, 16) * 16 * EPS).sum()) if sizes[0] > 0 else 0
        if rank:
            most = min(components, rank)
            vectors = across[:most].T
            signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), range(most)])
            known.components, known.eigenvalues = vectors * signs, sizes[:most] ** 2 / known.n
            known.total = float((sizes**2).sum() / known.n)
    for width, gram in grams(fit, fits, whitened=True).items():
        mean = gram[0, 1:] / fits[width].n
        fits[width].error = float(np.abs(gram[1:, 1:] / fits[width].n - np.outer(mean, mean) - np.eye(len(mean))).max())
    return fits


def whiten(vectors: DataFrame, components: int = 4) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` for each row and its first ``components``."""
    rows = whole(vectors)
    fits = fitted(written(rows.select("x").distinct()), components)
    shared = vectors.sparkSession.sparkContext.broadcast(fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in matrices(batch["x"]):
                known = shared.value.get(x.shape[1])
                if known is None or known.components is None:
                    continue
                exact, white = known.whitened(x)
                top = float(np.abs(exact.astype(np.float64)).max(initial=0))
                deviation = ((exact if top * top * x.shape[1] < SAFE else exact.astype(object)) ** 2).sum(axis=1).tolist()
                deviation = [d if d < 1 << 63 else None for d in deviation]
                for k in range(white.shape[1]):
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch["vec_id"].take(pa.array(at)), pa.array([k + 1] * len(at), pa.int32()), pa.array([known.n] * len(at), pa.int64()), pa.array(deviation, pa.int64()),
                            pa.array(white[:, k]), pa.array([float(known.eigenvalues[k] / known.total)] * len(at)), pa.array([known.error] * len(at)),
                        ],
                        names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
