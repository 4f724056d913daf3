"""Whitening against eigenvectors of the exact covariance."""

import math
from fractions import Fraction

import numpy as np
import pytest

from pagequarry.llm import base, queries, whitening


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


def brute(rows, spread=False):
    """``{row number: (n, deviation, x - S/n)}``, and eigenvalues (falling) and eigenvectors of each width."""
    xs = {k: tuple(math.floor(256 * c) for c in v) for k, (_, v) in enumerate(rows) if usable(v)}
    out, spectra = {}, {}
    for width in {len(x) for x in xs.values()}:
        fit = sorted({x for x in xs.values() if len(x) == width})
        n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
        if spread:  # the covariance itself cannot hold such variances: the singular vectors of the centred rows
            _, sizes, across = np.linalg.svd(np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)] for x in fit]))
            spectra[width] = sizes**2 / n, across.T
        else:
            exact = [[n * sum(x[i] * x[j] for x in fit) - sums[i] * sums[j] for j in range(width)] for i in range(width)]
            values, vectors = np.linalg.eigh(np.array([[float(Fraction(e, n * n)) for e in line] for line in exact]))
            spectra[width] = values[::-1], vectors[:, ::-1]
        for k, x in xs.items():
            if len(x) == width:
                d = [n * a - s for a, s in zip(x, sums, strict=True)]
                out[k] = n, sum(a * a for a in d), np.array([a / n for a in d])
    return out, spectra


def check(spark, rows, rank=None, tolerance=1e-7, spread=False, identity=1e-6):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, component string, n int")
    wanted, spectra = brute(rows, spread)
    found = whitening.whiten(df).collect()
    by_id = {}
    for r in found:
        by_id.setdefault((r["vec_id"], r["component"]), []).append(r)
    total = 0
    for k, (n, deviation, centred) in wanted.items():
        values, vectors = spectra[len(centred)]
        count = min(4, len(centred)) if rank is None else min(rank, 4)
        for c in range(count):
            total += 1
            mine = [r for r in by_id[rows[k][0], c + 1] if r["n"] == n and r["deviation"] == (deviation if deviation < 1 << 63 else None)]
            assert mine
            e = values[c]
            assert any(abs(abs(r["whitened"]) - abs(centred @ vectors[:, c] / math.sqrt(e))) < tolerance for r in mine)
            assert all(abs(r["explained"] - e / values.sum()) < 1e-9 and r["identity_error"] < identity for r in mine)
    assert len(found) == total
    return found


def test_components_are_those_of_the_exact_covariance(spark):
    base.prepare(spark)
    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    data = rng.normal(size=(400, 12)) * np.geomspace(3, 0.01, 12) @ turn + 7
    rows = [(k, v.tolist()) for k, v in enumerate(data)]
    rows += [(500 + k, rows[0][1]) for k in range(200)] + [(3, rows[3][1]), (None, rows[4][1]), (7, rows[8][1])]
    rows += [(900, None), (901, []), (902, [1.0] * 11 + [None]), (903, [1.0] * 11 + [float("nan")]), (904, [float("-inf")] + [1.0] * 11)]
    rows += [(950 + k, rng.normal(size=5).tolist()) for k in range(30)]
    check(spark, rows)


@pytest.mark.parametrize(("scale", "tolerance"), [(1.0, 1e-7), (1e6, 1e-2)])
def test_small_variances_beside_large_ones(spark, scale, tolerance):
    """Directions whose variances differ by more than a covariance matrix can hold, and one without variance."""
    base.prepare(spark)
    rng = np.random.default_rng(6)
    big = np.round(rng.normal(size=300) * scale * 1e3)
    data = np.stack([big, big + rng.integers(-2, 3, 300) / 256, big - rng.integers(-2, 3, 300) / 256, np.full(300, 4.0)], axis=1)
    found = check(spark, [(k, v.tolist()) for k, v in enumerate(data)], rank=3, tolerance=tolerance, spread=True, identity=1e-4)
    assert {r["component"] for r in found} == {1, 2, 3}


def test_few_vectors_and_none(spark):
    base.prepare(spark)
    check(spark, [(1, [1.0, 2.0, 3.0]), (2, [2.0, 4.5, 3.0]), (3, [0.0, 4.0, 3.0])], rank=2)
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(same).count() == 0 and whitening.whiten(same.filter("false")).count() == 0
    huge = spark.createDataFrame([(1, [1e300, 2.0]), (2, [-1e300, 3.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert all(r["deviation"] is None for r in whitening.whiten(huge).collect() if r["vec_id"] < 3)


def test_registered_query_whitens_the_table(spark):
    rows = queries.registry()["op12_whitening"](spark, "/root/testdata/sf0.001").collect()
    given = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    wanted, spectra = brute(given)
    of = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(rows) == 4 * len(wanted)
    for k, (n, deviation, centred) in wanted.items():
        values, vectors = spectra[len(centred)]
        for c in range(4):
            r = of[given[k][0], c + 1]
            assert (r["n"], r["deviation"]) == (n, deviation) and r["identity_error"] < 1e-9
            assert abs(abs(r["whitened"]) - abs(centred @ vectors[:, c] / math.sqrt(values[c]))) < 1e-8
