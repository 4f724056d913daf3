"""Ranked search against scoring every document for every item."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import lower_ascii, odd_documents

from pagequarry.llm import base, lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, k=10):
    """``{(item_id, rank): (doc_id, score)}``."""
    cut = [(i, collections.Counter(TERM.findall(lower_ascii(t)))) for i, t in docs]
    cut = [(i, c, sum(c.values())) for i, c in cut if c]
    n_docs, n_terms = len(cut), sum(n for *_, n in cut)
    df = collections.Counter(t for _, c, _ in cut for t in c)
    asked = collections.defaultdict(collections.Counter)
    for i, t in items:
        asked[i].update(TERM.findall(lower_ascii(t)))
    out = {}
    for item, q in asked.items():
        scores = []
        for i, c, n in cut:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(q[t] * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in q if c[t])
            if score > 0:
                scores.append((-score, i is None, i))
        for rank, (score, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out[item, rank] = (i, -score)
    return out


def same(spark, docs, items, k=10):
    found = lexical.search(docs, items, k).collect()
    wanted = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], k)
    assert {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in found} == wanted and len(found) == len(wanted)
    return len(found)


@pytest.mark.parametrize(("slots", "block"), [(1 << 20, 4096), (16, 8)])
def test_best_documents_equal_brute_force(spark, monkeypatch, slots, block):
    """Common and rare words, many equal scores; small blocks and bundles, and slots that terms must share."""
    monkeypatch.setattr(lexical, "SLOTS", slots)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    monkeypatch.setattr(lexical, "BUNDLE_ITEMS", 3)
    base.prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    random.seed(8)
    words = [f"W{k}" if k % 3 else f"wörter{k}" for k in range(400)]
    text = lambda n: random.choice([" ", ", ", "-", "\n"]).join(random.choices(words, weights=[1 / (k + 1) for k in range(400)], k=n))
    docs = [(random.randrange(10**6), text(random.randint(0, 60)), "a", 1) for k in range(400)]
    docs += [(5000 + k, docs[7][1], "a", 1) for k in range(60)] + [docs[9]] * 4 + [(None, docs[9][1], "a", 1), (-5, None, "a", 1)]
    items = [(k, text(random.randint(1, 25)), "b") for k in range(12)] + [(3, "W1 w1 W1", "b"), (None, "W2 w4", "b"), (50, "", "b"), (51, None, "b"), (52, "nowhere", "b"), (53, docs[7][1], "b")]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string, score string, cell int"), spark.createDataFrame(items, "item_id long, text string, terms string")
    assert same(spark, docs.repartition(5), items) > 100
    assert same(spark, docs, items, 3) > 30


def test_odd_and_empty_tables(spark):
    docs = odd_documents(base.prepare(spark))
    items = spark.createDataFrame([(1, "quick FOX 日本語"), (2, "lorem ipsum ipsum dolor"), (3, "one 123")], "item_id long, text string")
    assert same(spark, docs, items) > 5
    assert lexical.search(docs.filter("false"), items).count() == 0 and lexical.search(docs, items.filter("false")).count() == 0


def test_pieces_of_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(lexical, "RUN", 16)
    random.seed(2)
    texts = ["".join(random.choices("abZ9é .,-", k=random.randint(0, 90))) for _ in range(60)] + ["x" * 100, "y" * 40 + " " + "z" * 50, "", None, "a" * 16, "b"]
    sizes, (terms, rows, counts) = lexical.term_counts(pa.array(texts))
    cut = [collections.Counter(TERM.findall(lower_ascii(t))) for t in texts]
    assert sizes.tolist() == [sum(c.values()) for c in cut]
    assert collections.Counter(rows.tolist()) == collections.Counter({k: len(c) for k, c in enumerate(cut) if c})
    code = {}
    for k, c in enumerate(cut):
        for t in c:
            (_, (h, _, _)) = lexical.term_counts(pa.array([t])) if t not in code else (None, ([code[t]], None, None))
            code[t] = int(h[0])
    assert collections.Counter(zip(rows.tolist(), map(int, terms), counts.tolist(), strict=True)) == collections.Counter((k, code[t], n) for k, c in enumerate(cut) for t, n in c.items())
    assert len(set(code.values())) == len(code)


def test_norms_beyond_64_bits():
    sizes = np.array([1, 10**9], np.int64)
    assert lexical.norms(sizes, 10**12, 10**15).tolist() == [25, 25 + 75 * 10**9 * 10**12 // 10**15]
