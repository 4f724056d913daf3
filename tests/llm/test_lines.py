"""Line dedup against a plain loop."""

import collections
import hashlib
import random

import pytest
from helpers import lower_ascii, odd_documents

from pagequarry.llm import base, lines


def brute(rows, least_chars=40, least_docs=5):
    """``[(doc_id, text left or None, lines, dropped)]``."""
    key = lambda line: lower_ascii(line.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= least_chars:
                    holders[key(line)].add(i)
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        gone = [i is not None and len(holders[key(x)]) >= least_docs and max(holders[key(x)]) != i for x in all_]
        left = "\n".join(x for x, g in zip(all_, gone, strict=True) if not g)
        out.append((i, None if t is None else left, len(all_), sum(gone)))
    return out


def same(spark, docs, least_chars, least_docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    wanted = brute(rows, least_chars, least_docs)
    found = lines.digests(docs, least_chars, least_docs).collect()
    assert collections.Counter(map(tuple, found)) == collections.Counter((i, n, g, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, n, g in wanted)
    cut = lines.drop_lines(docs, least_chars, least_docs)
    assert cut.columns == docs.columns
    assert collections.Counter((r["doc_id"], r["text"]) for r in cut.collect()) == collections.Counter((i, t) for i, t, _, _ in wanted)
    return sum(g for *_, g in wanted)


@pytest.mark.parametrize("hot", [1, 4096])
def test_lines_equal_a_plain_loop(spark, monkeypatch, hot):
    """Few lines in many documents, blanks and case around them, repeats inside a document, ids that occur twice or not at all."""
    monkeypatch.setattr(lines, "HOT", hot)
    base.prepare(spark)
    random.seed(3)
    pool = ["common line number one", "COMMON line number one", "  common line number one\t", "zwei Zeilen für alle", "ZWEI ZEILEN FÜR ALLE", "日本語の行です。長い行です。", "short", "", " ", "\r"]
    pool += [f"rare line number {k:02}" for k in range(40)]
    rows = [(random.choice([None, *range(50)]), random.choice([None, ""]) if k % 17 == 0 else "\n".join(random.choices(pool, k=random.randint(1, 12)))) for k in range(150)]
    rows += [rows[5]] * 3 + [(1000 + k, "common line number one") for k in range(60)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, id string, `row` string")
    assert same(spark, docs, 10, 5) > 100
    assert same(spark, docs, 13, 2) > 100


def test_lines_of_odd_documents(spark):
    docs = odd_documents(base.prepare(spark))
    assert same(spark, docs, 40, 2) == 1
    assert lines.digests(docs.filter("false")).count() == 0 and lines.drop_lines(docs.filter("false")).columns == docs.columns
