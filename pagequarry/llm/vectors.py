"""What the vector operators share: which vectors count, and their rows as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str = "embedding") -> Column:
    """Whether a vector has a direction: not null, only finite components, one of them not zero."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(column).isNotNull() & finite & F.exists(column, lambda x: x != 0), F.lit(False))


def doubles(df: DataFrame) -> DataFrame:
    return df.withColumn("embedding", F.col("embedding").cast("array<double>"))


def rows_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equally long vectors as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths; scaled first, so that very large components do not overflow."""
    top = np.abs(x).max(axis=1, initial=0.0)
    top = np.where(top > 0, top, 1.0)
    return np.sqrt(((x / top[:, None]) ** 2).sum(axis=1)) * top


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; equal pairs give equal numbers wherever they stand."""
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    bad = ~(np.isfinite(na * nb) & (na * nb > 1e-290))
    if bad.any():
        na[bad], nb[bad] = 1.0, 1.0
        a, b = a.copy(), b.copy()
        a[bad], b[bad] = a[bad] / lengths(a[bad])[:, None], b[bad] / lengths(b[bad])[:, None]
    return (a * b).sum(axis=1) / (na * nb)
