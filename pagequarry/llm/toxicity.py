"""Toxic spans by a linear-chain conditional random field.

The field has two states, plain and toxic, over the words of a text (runs of letters, lower case). A word's features are
its hash and the hashes of its first 3 to 8 and last four letters; states of neighbours are tied by transition weights.
Forward-backward marginals give each word's chance to be toxic. A document's score is a logistic function of its largest
chance and of the sum of all chances, fitted to document labels, because a doubtful word counts when it recurs. Its
offending offsets are the runs of words whose chance is at least one half.

Labels mark documents, training needs labelled words. A word or beginning of a word is telling if it stands in at least
:data:`CONTEXTS` different contexts of toxic documents (copies of one text repeat their contexts, so they count once)
and has :data:`LIFT` times as many contexts a document there as in clean ones. Words of toxic documents with a telling
beginning are labelled toxic, all other words plain. The field is fitted to windows of labelled words by numpy gradient
steps. All of that uses a bounded sample of labelled rows; the bounds are parameters. Scoring covers every word of every
text: the sequence is cut into lanes that run side by side, and messages between lanes are exact.

Defined results: a null, empty or letterless text has no spans and the score of a text without toxic words. Repeated rows
are scored each, a null ``doc_id`` stays null, other columns are ignored, and stay in :func:`reject`; texts of any length are
read whole; an empty table gives an empty result. Rows with a null label do not train; without
toxic labelled rows every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm import base, text

#: Feature buckets per kind, words per training window, windows per sampled row.
BUCKETS, WINDOW, WINDOWS = 1 << 16, 24, 6
HEADS = (3, 4, 5, 6, 7, 8)
KINDS = len(HEADS) + 2
#: Sampled rows of each label (on average; rows are chosen by a hash of their id).
SAMPLE_ROWS = 1500
#: What makes a word of toxic documents a toxic word.
CONTEXTS, LIFT, MOST_WORDS = 8, 10.0, 10_000
PASSES, RATE = 12, 0.5
#: Chances below this are those of unknown words; they do not add up to a toxic document however long it is.
DOUBT = 0.3


@dataclass
class Model:
    weights: np.ndarray  # of the toxic state, by feature bucket
    start: np.ndarray  # log weights of the two states
    moves: np.ndarray  # log weights of from-state, to-state
    document: np.ndarray  # of the document score: constant, largest chance, sum, log of sum


def words(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Hashes (whole word, heads, tail), start, end and text number of each word; starts and ends count characters of all texts."""
    is_letter, lower = text.letters()
    codes, offsets = text.code_points(texts)
    starts, ends, owner = text.run_bounds(is_letter[codes], offsets)
    values = text.mix(lower[codes].astype(np.uint64) + np.uint64(99))
    heads = [text.run_hashes(values, starts, np.minimum(starts + k, ends)) for k in HEADS]
    tails = text.run_hashes(values, np.maximum(ends - 4, starts), ends)
    return np.stack([text.run_hashes(values, starts, ends), *heads, tails], axis=1), starts, ends, owner


def features(hashes: np.ndarray) -> np.ndarray:
    """Feature buckets of words."""
    return (hashes % np.uint64(BUCKETS)).astype(np.int32) + np.arange(KINDS, dtype=np.int32) * BUCKETS


def pieces(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts with up to ``most`` characters together, and the number of the first."""
    low, size = 0, 0
    for k, one in enumerate(texts):
        if size and size + len(one) > most:
            yield low, texts[low:k]
            low, size = k, 0
        size += len(one)
    if low < len(texts):
        yield low, texts[low:]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """The field from ``docs(doc_id, text)`` and ``labels(doc_id, label)``; nothing where no toxic row is labelled."""
    sample = base.labelled_sample(docs, labels, sample_rows, each=True, salt=3)
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if not sizes.get(1):
        return None

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, some in pieces(batch["text"].to_pylist()):
                labels = batch["label"].to_numpy()[low : low + len(some)]
                hashes, _, _, owner = words(some)
                whole, edge = hashes[:, 0], np.zeros(min(1, len(hashes)), np.uint64)
                around = np.concatenate([edge, whole[:-1]]) * np.uint64(text.PRIME) + np.concatenate([whole[1:], edge])
                toxic = labels[owner] == 1
                _, at = np.unique(text.mix(whole + text.mix(around + toxic.astype(np.uint64))), return_index=True)
                heads = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(hashes[at, :-1]).view(np.int64).reshape(-1)), KINDS - 1).cast(pa.list_(pa.int64()))
                columns = [pa.array(whole[at].view(np.int64)), pa.array(text.mix(around)[at].view(np.int64)), pa.array(toxic[at]), heads]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "context", "toxic", "heads"])

    seen = sample.select("text", "label").mapInArrow(contexts, "word long, context long, toxic boolean, heads array<long>")
    once = seen.groupBy("word", "context", "toxic").agg(F.first("heads").alias("heads"))
    by_word = once.groupBy("word").agg(F.first("heads").alias("heads"), F.count_if("toxic").alias("toxic"), F.count_if(~F.col("toxic")).alias("clean"))
    by_head = by_word.select(F.explode(F.array_distinct("heads")).alias("head"), "toxic", "clean").groupBy("head").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # Contexts a document, here against there.
    lift = (F.col("toxic") / sizes[1]) / ((F.col("clean") + 1) / (sizes.get(0, 0) + 1))
    marked = by_head.filter((F.col("toxic") >= CONTEXTS) & (lift >= LIFT)).orderBy(F.desc("toxic"), "head").limit(MOST_WORDS).select("head").collect()
    telling = np.sort(np.array([r["head"] for r in marked], dtype=np.int64).view(np.uint64))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for one, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist(), strict=True):
                hashes = words([one])[0]
                out += windows_of(features(hashes), (np.isin(hashes[:, :-1], telling).any(axis=1) & (label == 1)).astype(np.int8), np.isin(hashes[:, :-1], telling).any(axis=1))
            columns = [pa.array([o[k] for o in out], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["features", "labels"])

    got = sample.select("text", "label").mapInArrow(cut, "features binary, labels binary").orderBy("features", "labels").collect()
    found = np.array([np.frombuffer(r["features"], np.int32) for r in got], dtype=np.int32).reshape(-1, WINDOW, KINDS)
    model = fit(found, np.array([np.frombuffer(r["labels"], np.int8) for r in got]).reshape(-1, WINDOW))

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = tag(batch["text"].to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch["label"], *(pa.array([f[k] for f in found], pa.float64()) for k in (2, 3))], names=["label", "most", "total"])

    rows = sample.select("text", "label").mapInArrow(evidence, "label int, most double, total double").orderBy("label", "most", "total").collect()
    model.document = logistic(inputs([r["most"] for r in rows], [r["total"] for r in rows]), np.array([r["label"] for r in rows]))
    return model


def inputs(most: list[float], total: list[float]) -> np.ndarray:
    """What the document score is made of."""
    most, total = np.array(most), np.array(total)
    return np.stack([np.ones_like(most), most, np.minimum(total, 10.0), np.log(total + 0.01)], axis=1)


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic function of ``x`` by Newton steps with a small penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (y - p) - 1e-2 * w)
    return w


def windows_of(features: np.ndarray, labels: np.ndarray, telling: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Windows of labelled words of one text: half around telling words, the rest evenly spaced. Label -1 pads."""
    if not len(labels):
        return []
    hits = np.maximum(0, np.flatnonzero(telling)[: WINDOWS // 2] - WINDOW // 2)
    even = np.linspace(0, max(0, len(labels) - WINDOW), WINDOWS - len(hits)).astype(np.int64)
    out = []
    for at in np.unique(np.concatenate([hits, even])):
        n = min(WINDOW, len(labels) - at)
        full, marks = np.zeros((WINDOW, KINDS), np.int32), np.full(WINDOW, -1, np.int8)
        full[:n], marks[:n] = features[at : at + n], labels[at : at + n]
        out.append((full.tobytes(), marks.tobytes()))
    return out


def fit(features: np.ndarray, labels: np.ndarray) -> Model:
    """Gradient ascent on the log-likelihood of the labels, with step sizes by past gradients and a small weight decay."""
    weights = np.zeros(KINDS * BUCKETS)
    ties = np.array([0.0, -2.0, 0.0, -3.0, -1.0, -1.0])  # start of plain, toxic; moves plain-plain, plain-toxic, toxic-plain, toxic-toxic
    past, past_ties = np.full(len(weights), 1e-3), np.full(6, 1.0)
    rng = np.random.default_rng(5)
    for _ in range(PASSES):
        for rows in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // 256)):
            found, marks = features[rows], labels[rows]
            real = marks >= 0
            chance, starts, moves = _expected(np.where(real, weights[found].sum(axis=2), 0.0), ties, real)
            error = np.where(real, (marks == 1) - chance, 0.0)
            slope = np.bincount(found.reshape(-1), weights=np.repeat(error.reshape(-1), KINDS), minlength=len(weights)) / len(rows)
            slope -= 1e-5 * weights
            toxic = (marks == 1).astype(np.int64)
            both = real[:, 1:] & real[:, :-1]
            seen = np.bincount((toxic[:, :-1] * 2 + toxic[:, 1:])[both], minlength=4)
            first = np.bincount(toxic[:, 0], minlength=2)
            tie = (np.concatenate([first, seen]) - np.concatenate([starts, moves])) / len(rows)
            past += slope**2
            past_ties += tie**2
            weights += RATE * slope / np.sqrt(past)
            ties += RATE * tie / np.sqrt(past_ties)
    return Model(weights.astype(np.float32), ties[:2], ties[2:].reshape(2, 2), np.zeros(4))


def _expected(scores: np.ndarray, ties: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chance of toxic at each place, and expected counts of starts and moves, over equally long windows."""
    n, size = scores.shape
    emit = np.stack([np.ones_like(scores), np.exp(np.clip(scores, -30, 30))], axis=2)
    move = np.exp(ties[2:].reshape(2, 2))
    ahead, back = np.empty((n, size, 2)), np.ones((n, size, 2))
    ahead[:, 0] = np.exp(ties[:2]) * emit[:, 0]
    ahead[:, 0] /= ahead[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, size):
        step = ahead[:, t - 1] @ move * emit[:, t]
        ahead[:, t] = np.where(real[:, t, None], step / step.sum(axis=1, keepdims=True), ahead[:, t - 1])
    for t in range(size - 2, -1, -1):
        step = (back[:, t + 1] * emit[:, t + 1]) @ move.T
        back[:, t] = np.where(real[:, t + 1, None], step / step.sum(axis=1, keepdims=True), 1.0)
    both = ahead * back
    chance = both[:, :, 1] / both.sum(axis=2)
    pair = ahead[:, :-1, :, None] * move * (emit * back)[:, 1:, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    pair[~(real[:, 1:] & real[:, :-1])] = 0
    return chance, np.array([(1 - chance[:, 0]).sum(), chance[:, 0].sum()]), pair.sum(axis=(0, 1)).reshape(4)


def marginals(scores: np.ndarray, first: np.ndarray, model: Model, lanes: int = 512) -> np.ndarray:
    """Chance of toxic at each place of the sequences laid end to end; ``first`` marks where each begins.

    The places are cut into lanes of equal length. A first sweep gives each lane's whole transfer matrix, a loop over
    lanes gives the message that enters each, and a second sweep gives every message inside.
    """
    n = len(scores)
    if not n:
        return np.zeros(0)
    size = -(-n // min(lanes, n))
    count = -(-n // size)
    # step[t] carries a message from the place before to this one; at a beginning both rows are the start weights.
    step = np.ones((count * size, 2, 2))
    step[:n] = np.where(first[:, None, None], np.exp(model.start)[None, None, :], np.exp(model.moves)[None])
    step[:n, :, 1] *= np.exp(np.clip(scores, -30, 30))[:, None]
    step[n:] = np.eye(2)
    step = np.ascontiguousarray(step.reshape(count, size, 2, 2).transpose(1, 0, 2, 3))
    whole = step[0].copy()
    for t in range(1, size):
        whole = whole @ step[t]
        whole /= whole.sum(axis=(1, 2), keepdims=True)
    enter, leave = np.empty((count, 2)), np.empty((count, 2))
    message = np.array([0.5, 0.5])
    for k in range(count):
        enter[k] = message
        message = message @ whole[k]
        message = message / message.sum()
    message = np.array([0.5, 0.5])
    for k in range(count - 1, -1, -1):
        leave[k] = message
        message = whole[k] @ message
        message = message / message.sum()
    ahead = np.empty((size, count, 2))
    message = enter
    for t in range(size):
        message = np.einsum("ki,kij->kj", message, step[t])
        message /= message.sum(axis=1, keepdims=True)
        ahead[t] = message
    message = leave
    for t in range(size - 1, -1, -1):
        both = ahead[t] * message
        ahead[t, :, 1] = both[:, 1] / both.sum(axis=1)
        message = np.einsum("kij,kj->ki", step[t], message)
        message /= message.sum(axis=1, keepdims=True)
    return ahead[:, :, 1].T.reshape(-1)[:n]


def tag(texts: list[str], model: Model | None) -> list[tuple[float, list[tuple[int, int]], float, float]]:
    """Score, offending character ranges, largest chance and sum of chances of each text."""
    if model is None:
        return [(0.0, [], 0.0, 0.0) for _ in texts]
    most, total = np.zeros(len(texts)), np.zeros(len(texts))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for low, some in pieces(texts):
        hashes, starts, ends, owner = words(some)
        if not len(owner):
            continue
        begins = np.concatenate([[True], owner[1:] != owner[:-1]])
        chance = marginals(model.weights[features(hashes)].sum(axis=1), begins, model)
        at = np.flatnonzero(begins)
        most[low + owner[at]] = np.maximum.reduceat(chance, at)
        total[low + owner[at]] = np.add.reduceat(np.where(chance >= DOUBT, chance, 0.0), at)
        before = np.concatenate([[0], np.cumsum([len(t) for t in some])])
        hot = chance >= 0.5
        follows = np.concatenate([[False], hot[:-1]]) & ~begins
        for k in np.flatnonzero(hot):
            own = spans[low + owner[k]]
            start, end = int(starts[k] - before[owner[k]]), int(ends[k] - before[owner[k]])
            if follows[k]:
                own[-1] = (own[-1][0], end)
            else:
                own.append((start, end))
    scores = 1 / (1 + np.exp(-np.clip(inputs(most, total) @ model.document, -30, 30)))
    return list(zip(scores.tolist(), spans, most.tolist(), total.tolist(), strict=True))


def score(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """``(doc_id, score, predicted, spans)`` of each row's whole text; spans are character ranges, end exclusive."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = tag([t or "" for t in batch["text"].to_pylist()], model)
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s, _, _ in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            columns = [batch["doc_id"], pa.array([f[0] for f in found], pa.float64()), pa.array([int(f[0] >= threshold) for f in found], pa.int32()), spans]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int, spans array<struct<start:int,end:int>>")


def reject(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below the threshold. No join, so ids may repeat or be null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = tag([t or "" for t in batch["text"].to_pylist()], model)
            yield batch.filter(pa.array([f[0] < threshold for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
