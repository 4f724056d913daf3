"""Near-duplicate vectors and nearest neighbours against all pairs."""

import collections
import os
import urllib.parse

import numpy as np
import pytest
from helpers import components

from pagequarry.llm import base, hamming, nearest


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab, "x", "y", 0) for i, v, lab in rows], "vec_id long, embedding array<float>, label int, score string, key string, id int")


def good(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))


def clusters(seed, n=120, width=24):
    rng = np.random.default_rng(seed)
    rows, centres = [], rng.normal(size=(5, width))
    for k in range(n):
        spread = (0.0, 0.02, 0.03, 0.05)[k % 4]
        rows.append((k, (centres[k % 5] + spread * np.sqrt(width) * rng.normal(size=width)).tolist(), int(k % 3 == 0)))
    bad = [None, [0.0] * width, [None] + [1.0] * (width - 1), [float("nan")] * width, [float("inf")] + [0.0] * (width - 1), []]
    rows += [(200 + k, v, 0) for k, v in enumerate(bad)]
    rows += [(300, rows[1][1], rows[1][2]), (301, rows[1][1], None), (302, rows[1][1][:10], rows[1][2]), (303, rows[1][1][:10], rows[1][2]), (None, rows[1][1], 0), (4, rows[4][1], rows[4][2])]
    rows += [(400 + k, rows[8][1], 0) for k in range(20)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_links_equal_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(hamming, "BLOCK", 8)
    monkeypatch.setattr(hamming, "TASK_ROWS", 200)
    base.prepare(spark)
    rows = clusters(seed)
    ok = [k for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and good(v)]
    links = [(a, b) for a in ok for b in ok if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and cosine(rows[a][1], rows[b][1]) >= 0.98]
    n = collections.Counter(a for a, _ in links)
    of = components({r[0] for r in rows if r[0] is not None}, [(rows[a][0], rows[b][0]) for a, b in links])
    wanted = collections.Counter((i, n[k], of.get(i), True if i is None else of[i] == i) for k, (i, _, _) in enumerate(rows))
    assert len(links) > 300
    assert collections.Counter(tuple(r) for r in hamming.links(table(spark, rows)).collect()) == wanted
    assert hamming.links(table(spark, rows).filter("false")).count() == 0


def expected(rows):
    ok = [k for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and good(v)]
    links = [(a, b) for a in ok for b in ok if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and cosine(rows[a][1], rows[b][1]) >= 0.98]
    n = collections.Counter(a for a, _ in links)
    of = components({r[0] for r in rows if r[0] is not None}, [(rows[a][0], rows[b][0]) for a, b in links])
    return collections.Counter((i, n[k], of.get(i), True if i is None else of[i] == i) for k, (i, _, _) in enumerate(rows))


@pytest.mark.parametrize(("block", "few", "bits"), [(20, 0, None), (1000, 0, 5), (2, 64, None)])
def test_links_by_tables_and_passes_equal_all_pairs(spark, monkeypatch, block, few, bits):
    """Blocks that pair up over several passes, empty ones among them, and tables with and without keys."""
    for name, value in (("BLOCK", block), ("TASK_ROWS", 30), ("FEW", few), ("STEP", 7), ("PROBES", 50), ("TILE", 64), ("PASS", 8)):
        monkeypatch.setattr(hamming, name, value)
    if bits:
        monkeypatch.setattr(hamming, "key_bits", lambda energy, *_: min(bits, energy.shape[1]))
    base.prepare(spark)
    rows = clusters(3, n=60)
    rows += [(500, [0.0, 1.0] * 12, 0), (501, [-0.0, 1.0] * 12, 0)]
    found = collections.Counter(tuple(r) for r in hamming.links(table(spark, rows)).collect())
    assert found == expected(rows)


def test_what_links_writes_follows_the_vectors(spark, monkeypatch):
    """Flips, candidates and pairs stay in the tasks: the tables that are written hold little more than the vectors."""
    base.prepare(spark)
    vectors, sizes = np.random.default_rng(5).normal(size=(2000, 64)), []

    def written(df):
        got = base.written(df)
        sizes.append(sum(os.path.getsize(urllib.parse.urlparse(f).path) for f in got.inputFiles()))
        return got

    monkeypatch.setattr(hamming, "written", written)
    assert hamming.links(table(spark, [(k, v.tolist(), 0) for k, v in enumerate(vectors)])).count() == 2000
    assert 0 < sum(sizes) < 3 * vectors.size * 4


def test_flips_are_all_sets_within_the_budget():
    energy = np.array([[3, 1, 4, 1, 5], [0, 9, 9, 9, 2]])
    found = set(zip(*(x.tolist() for x in hamming.flips(energy, 5)), strict=True))
    wanted = {(r, m) for r in range(2) for m in range(32) if sum(int(energy[r, k]) for k in range(5) if m >> k & 1) <= 5}
    assert found == wanted


def test_nearest_equal_all_pairs(spark, monkeypatch):
    for name, value in (("QUERY_TILE", 5), ("TILE", 30), ("STEP", 8)):
        monkeypatch.setattr(nearest, name, value)
    base.prepare(spark)
    rows = [r for r in clusters(3) if r[0] != 4] + [(4, clusters(3)[4][1], 0)]
    vectors = table(spark, rows)
    ok = [(i, v) for i, v, _ in rows if i is not None and good(v)]
    wanted = {}
    for q, u in ok:
        if q % 10 == 0:
            near = sorted((-cosine(u, v), i) for i, v in ok if i != q and len(u) == len(v))
            wanted[q] = near[:5]
    found = collections.defaultdict(list)
    for r in nearest.nearest(vectors, vectors.filter("vec_id % 10 = 0"), 5).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert found.keys() == {q for q in wanted if wanted[q]}
    exact = {(q, i): s for q in wanted for s, i in wanted[q]}
    for q, near in found.items():
        assert np.allclose([s for _, s in near], [-s for s, _ in wanted[q]], atol=1e-12)
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))
        assert sum((q, i) in exact for i, _ in near) >= len(near) - 1  # scores that differ by rounding only may change places
    assert nearest.nearest(vectors.filter("false"), vectors).count() == 0
    assert nearest.nearest(vectors, vectors.filter("false")).count() == 0


def test_the_smallest_vector_of_a_query_id_asks(spark):
    rows = [(0, [0.0, 1.0], 0), (0, [-1.0, 0.5], 0), (0, [1.0, 0.0], 0), (1, [-1.0, 0.4], 0), (2, [0.0, 2.0], 0), (3, [3.0, 0.0], 0)]
    vectors = table(spark, rows)
    for parts in (1, 5):
        found = nearest.nearest(vectors, vectors.filter("vec_id = 0").repartition(parts), 1).collect()
        assert [(r["query_id"], r["vec_id"]) for r in found] == [(0, 1)]


def test_repeated_ids_are_found_once(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 0.1], 0), (1, [1.0, 0.5], 0), (1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (0, [0.0, 1.0], 0)]
    vectors = table(spark, rows)
    found = nearest.nearest(vectors, vectors.filter("vec_id = 0 AND embedding[0] = 1"), 5).orderBy("rank").collect()
    assert [(r["vec_id"], r["rank"], round(r["score"], 6)) for r in found] == [(1, 1, 1.0), (2, 2, 0.0)]
