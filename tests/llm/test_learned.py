"""Language profiles and the quality model against plain loops over whole texts."""

import collections
import zlib

import numpy as np
import pytest
from helpers import SF, WORD

from pagequarry.llm import language_id, quality, queries, text

MASK = (1 << 64) - 1


def gram_hash(gram):
    total = ord(gram[0])
    for c in gram[1:]:
        total = (total * text.PRIME + ord(c)) & MASK
    return total


def gram_counts(document):
    """n-grams of 1 to 5 characters of the words, each with a blank on both sides, as a dictionary."""
    low = lambda c: c.lower() if len(c.lower()) == 1 else c
    words, counts = "".join(low(c) if c.isalpha() else " " for c in document).split(), collections.Counter()
    for word in words:
        padded = f" {word} "
        for n in range(1, language_id.LONGEST + 1):
            counts.update(g for k in range(len(padded) - n + 1) if (g := padded[k : k + n]) != " ")
    return counts


def ranked(counts):
    return sorted(counts, key=lambda g: (-counts[g], gram_hash(g)))[: language_id.RANKS]


def test_languages_equal_a_plain_loop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    totals = collections.defaultdict(collections.Counter)
    for r in docs:
        if r["text"] is not None and r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            totals[r["lang"]].update(gram_counts(r["text"]))
    profiles = {lang: {g: k for k, g in enumerate(ranked(c))} for lang, c in totals.items()}
    wanted = {}
    for r in docs:
        own = ranked(gram_counts(r["text"] or ""))
        apart = sorted((sum(abs(p[g] - k) if g in p else language_id.RANKS for k, g in enumerate(own)), lang) for lang, p in profiles.items())
        total = apart[0][0] + apart[1][0]
        wanted[r["doc_id"]] = (apart[0][1], apart[1][0] / total if total else 0.5) if own else ("und", 0.0)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in queries.registry()["op1_language_id"](spark, SF).collect()}
    assert found.keys() == wanted.keys()
    for k, (lang, score) in wanted.items():
        assert found[k][0] == lang and found[k][1] == pytest.approx(score, abs=1e-12)


def mix(x):
    x ^= x >> 30
    x = (x * 0xBF58476D1CE4E5B9) & MASK
    x ^= x >> 27
    x = (x * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def plain_features(document):
    """Buckets of the words, of words said twice, and of the 2 to 4 byte n-grams of a text."""
    data, out = document.encode(), []
    words = [w.encode() for w in WORD.findall(document)]
    for w in words:
        out.append(mix(sum(int(text._BYTES[b]) * pow(text.PRIME, k, 1 << 64) for k, b in enumerate(w)) & MASK) % quality.BUCKETS)
    out += [0 for a, b in zip(words, words[1:]) if a == b]
    for n in quality.SIZES:
        for k in range(len(data) - n + 1):
            total = 0
            for b in data[k : k + n]:
                total = (total * text.PRIME + b + 1) & MASK
            out.append(((total * int(quality._SALTS[n])) & MASK) >> 48)
    return collections.Counter(b % quality.BUCKETS for b in out)


def test_quality_features_equal_a_plain_loop():
    texts = ["The cat sat sat on the  mat.\nÜber 日本 sat sat", "", "a", "ab", "one one one", " \n"]
    parts = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    buckets, owner = quality.features(np.frombuffer(b"".join(parts), np.uint8), offsets)
    for k, t in enumerate(texts):
        assert collections.Counter(buckets[owner == k].tolist()) == plain_features(t)


def test_quality_step_follows_the_slope_of_the_loss(monkeypatch):
    """One pass over one text: the changes are those of finite differences of the loss."""
    monkeypatch.setattr(quality, "PASSES", 1)
    buckets, counts = np.array([3, 70, 900], np.int32), np.array([2, 1, 1], np.int32)
    gains, slope_of_bias = quality.fit([(1, buckets, counts)])
    rng = np.random.default_rng(11)
    vectors = rng.uniform(-1 / quality.WIDTH, 1 / quality.WIDTH, (quality.BUCKETS, quality.WIDTH)).astype(np.float32).astype(float)
    layer = rng.normal(0, 0.5, (quality.WIDTH, 2)).astype(np.float32).astype(float)
    bias, share = np.log([1 / 3, 2 / 3]), counts / counts.sum()

    def loss(mean, layer):
        scores = mean @ layer + bias
        return np.log(np.exp(scores).sum()) - scores[1]

    mean, step = share @ vectors[buckets], 1e-6
    at_mean = np.array([(loss(mean + step * e, layer) - loss(mean - step * e, layer)) / (2 * step) for e in np.eye(quality.WIDTH)])
    at_layer = np.zeros_like(layer)
    for i in range(quality.WIDTH):
        for j in range(2):
            moved = np.zeros_like(layer)
            moved[i, j] = step
            at_layer[i, j] = (loss(mean, layer + moved) - loss(mean, layer - moved)) / (2 * step)
    layer -= quality.RATE * at_layer
    vectors[buckets] -= 100 * quality.RATE * share[:, None] * at_mean
    assert np.allclose(gains, vectors @ (layer[:, 1] - layer[:, 0]), atol=1e-4) and slope_of_bias == pytest.approx(np.log(2), abs=1e-6)
