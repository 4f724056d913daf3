"""Quality scores by supervised subword embeddings.

Words and character n-grams are hashed into buckets, each bucket has a learned vector, a document is the mean of the
vectors of everything it holds, and a softmax layer tells the classes apart. Training is numpy stochastic gradient
descent on a bounded sample of the labelled rows; the bound is a parameter. Features are counted on the executors, and
a document has at most :data:`BUCKETS` of them, so what reaches the driver is bounded whatever the texts are.

Defined results: a null or empty text has no features and gets the score that the bias alone gives, the share of label 1.
Repeated rows are scored each, a null ``doc_id`` stays null, other columns are ignored, whole texts count. Training rows
with a null label are ignored; without any labelled row every score is 0.5. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pagequarry.llm import base, text

#: Hash buckets, vector length, character n-gram sizes.
BUCKETS, WIDTH, SIZES = 1 << 16, 16, (2, 3, 4)
#: Rows the model is trained on (on average; rows are chosen by a hash of their id), and passes over them.
SAMPLE_ROWS, PASSES, RATE = 4000, 6, 0.5

_SALTS = text.seeds(8, 7)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word, repeated word and character n-gram of the texts, and the text it is from (not in order)."""
    words, _, _, owner = text.byte_words(data, offsets)
    buckets, owners = [words % np.uint64(BUCKETS)], [owner]
    again = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])  # a word said twice in a row, whichever it is
    buckets.append(np.zeros(int(again.sum()), np.uint64))
    owners.append(owner[1:][again])
    codes = data.astype(np.uint64) + np.uint64(1)
    place = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    total = codes
    for n in range(2, max(SIZES) + 1):
        if len(data) < n:
            break
        total = total[:-1] * np.uint64(text.PRIME) + codes[n - 1 :]
        if n in SIZES:
            whole = place[: len(total)] == place[n - 1 :]
            # The high bits of a product depend on every factor; the low ones of a sum do not.
            buckets.append(((total * _SALTS[n]) >> np.uint64(48))[whole] % np.uint64(BUCKETS))
            owners.append(place[: len(total)][whole])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """Model from ``docs(doc_id, text)`` and ``labels(doc_id, label)``: what each bucket adds to the log-odds of label 1, and the bias."""
    chosen = base.labelled_sample(docs, labels, sample_rows, each=False, salt=2)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = base.strings(batch["text"])
            found = []
            for k in range(len(offsets) - 1):
                buckets, _ = features(data[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]))
                found.append(np.unique(buckets, return_counts=True))
            columns = [batch["doc_id"].cast(pa.string()), batch["label"], *(pa.array([base.packed(f[k].astype(np.int32)) for f in found], pa.binary()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "buckets", "counts"])

    found = chosen.mapInArrow(count, "id string, label int, buckets binary, counts binary").orderBy("id").collect()
    sample = [(r["label"], np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["counts"], np.int32)) for r in found]
    return fit([s for s in sample if len(s[1])])


def fit(sample: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float]:
    """Stochastic gradient descent over (label, buckets, counts)."""
    positive = sum(s[0] for s in sample)
    if not sample:
        return np.zeros(BUCKETS, np.float32), 0.0
    rng = np.random.default_rng(11)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32)
    prior = (positive + 1) / (len(sample) + 2)
    bias = np.log(np.array([1 - prior, prior], dtype=np.float32))
    weights = [(c / c.sum()).astype(np.float32) for _, _, c in sample]
    steps, total = 0, PASSES * len(sample)
    for _ in range(PASSES):
        for k in rng.permutation(len(sample)):
            label, buckets, _ = sample[k]
            rate = RATE * (1 - steps / total)
            steps += 1
            mean = weights[k] @ vectors[buckets]
            scores = mean @ layer + bias
            scores = np.exp(scores - scores.max())
            error = -scores / scores.sum()
            error[label] += 1
            back = layer @ error
            layer += rate * np.outer(mean, error)
            # The mean spreads the gradient thin over a long text; its length is put back.
            vectors[buckets] += (100 * rate) * weights[k][:, None] * back
    slope = layer[:, 1] - layer[:, 0]
    return (vectors @ slope).astype(np.float32), float(bias[1] - bias[0])


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.7) -> DataFrame:
    """``(doc_id, score, predicted)`` of each row's whole text."""
    gains, bias = model
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = base.strings(batch["text"])
            odds = np.full(len(offsets) - 1, bias)
            for low, high in base.runs(offsets):
                cut = offsets[low : high + 1] - offsets[low]
                buckets, owner = features(data[offsets[low] : offsets[high]], cut)
                sums = np.bincount(owner, weights=gains[buckets], minlength=high - low)
                odds[low:high] += sums / np.maximum(1, np.bincount(owner, minlength=high - low))
            chance = 1 / (1 + np.exp(-odds))
            columns = [batch["doc_id"], pa.array(chance), pa.array((chance >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
