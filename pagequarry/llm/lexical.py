"""Ranked lexical search by pipelined term partitioning.

Terms are dealt to a few owners, rare terms to the first. Items travel as bundles from owner to owner: at each stage a bundle
meets the owner's postings (``cogroup``), adds their integer contributions to its sparse accumulators, one score a document
so far, and goes on. After the last owner the best documents of each item are selected.

Documents are dealt into blocks and items into bundles, so a stage's group is one bundle and one block: a term that every
document holds is spread over all blocks, and memory follows ``BLOCK_DOCS`` and ``BUNDLE_ITEMS``, not the data. What an
accumulator can still gain is bounded by the weights of the terms to come; documents that can no longer be among the best of
their block are dropped from the bundle, which never changes the result. A table of ``SLOTS`` slots says which terms occur
in items and who owns them; it is broadcast and has that size whatever the data. Terms that share a slot share an owner,
and terms no item asks for are left out when they meet the bundle.

Terms are compared by 64-bit hashes: two different terms of which an item holds one are taken for the same with a chance of
about ``terms of items * terms of documents / 2**64``.

Defined results: each row of the documents is a document, so repeated rows are ranked each, and a null ``doc_id`` stays null
and comes last among equal scores; null or empty texts have no terms and are found by nothing; rows that share an
``item_id`` (null is an id too) are one item whose terms add up; items without a score above 0 have no rows. Texts of any
length are read whole, in pieces cut between terms. Other columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.base import packed, parts, strings, written
from pagequarry.llm.text import run_bounds, run_hashes, seeds

#: Stages, slots of the table of owners, about the documents of a block, about the items of a bundle, bytes hashed at a time.
OWNERS, SLOTS, BLOCK_DOCS, BUNDLE_ITEMS, RUN = 4, 1 << 20, 4096, 512, 1 << 20
#: Each owner but the last has terms that fewer than one in so many documents hold.
SHARES = (512, 64, 8)
#: Scores are parts of ``UNIT``; a document's length counts for ``SLOPE`` per cent of the average length.
UNIT, SLOPE = 1_000_000_000, 75
#: No contribution of a term is larger than its weight times this, as the length norm is positive.
MOST = UNIT // 1000

_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_CODES = seeds(256, 13)
_CODES[0x41:0x5B] = _CODES[0x61:0x7B]  # A-Z count as a-z


def term_hashes(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the terms of a text column and the number of the text each is from, piece by piece."""
    data, offsets = strings(column)
    at = 0
    while at < len(data):
        end = min(at + RUN, len(data))
        if end < len(data):  # back to the last place between terms, or on to the next one
            gaps = np.flatnonzero(~_TERM[data[at:end]])
            before = max(at + gaps[-1] + 1 if len(gaps) else 0, offsets[np.searchsorted(offsets, end, side="right") - 1])
            while before <= at:
                gaps = np.flatnonzero(~_TERM[data[end : end + RUN]])
                after = min(end + gaps[0] + 1 if len(gaps) else len(data) + RUN, offsets[np.searchsorted(offsets, end)])
                before, end = (after, end) if after <= end + RUN else (before, end + RUN)
            end = before
        low, high = np.searchsorted(offsets, at, side="right") - 1, np.searchsorted(offsets, end)
        piece = data[at:end]
        starts, ends, owner = run_bounds(_TERM[piece], np.clip(offsets[low : high + 1], at, end) - at)
        yield run_hashes(_CODES[piece], starts, ends), owner + low
        at = end


def counted(terms: np.ndarray, texts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms with the texts that hold them, in order of the term and the text, each pair once with its counts added."""
    order = np.lexsort((texts, terms))
    terms, texts, counts = terms[order], texts[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], (terms[1:] != terms[:-1]) | (texts[1:] != texts[:-1])])) if len(terms) else np.zeros(0, np.int64)
    return terms[first], texts[first], np.add.reduceat(counts, first) if len(first) else counts


def term_counts(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The number of terms of each text, and its terms with their counts, only those in ``wanted`` slots where given."""
    sizes, found = np.zeros(len(column), np.int64), []
    for hashes, owner in term_hashes(column):
        sizes += np.bincount(owner, minlength=len(column))
        if wanted is not None:
            kept = wanted[hashes & np.uint64(len(wanted) - 1)]
            hashes, owner = hashes[kept], owner[kept]
        terms, number = np.unique(hashes, return_inverse=True)
        pairs, counts = np.unique(number * len(column) + owner, return_counts=True)
        found.append((terms[pairs // len(column)], pairs % len(column), counts))
    none = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    return sizes, counted(*(np.concatenate(x) for x in zip(*(found or none), strict=True)))


def item_terms(items: DataFrame) -> DataFrame:
    """``(item_id, term, q)``: how often each item holds each of its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, (terms, rows, counts) = term_counts(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["item_id"].take(pa.array(rows)), pa.array(terms.view(np.int64)), pa.array(counts)], names=["item_id", "term", "q"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, term long, q long").groupBy("item_id", "term").agg(F.sum("q").alias("q"))


def slot_table(rows: DataFrame, size: int) -> np.ndarray:
    """``rows(slot, owner)``, one a slot and so up to ``size``, as an array; -1 where a slot is free."""
    found = rows.toArrow()
    table = np.full(size, -1, np.int8)
    table[found["slot"].to_numpy()] = found["owner"].to_numpy()
    return table


def index(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """Postings of the terms in ``wanted`` slots. Each row is a unit, some documents with their lengths and packed postings."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes, (terms, rows, counts) = term_counts(batch["text"], shared.value)
            first = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
            ends = pa.array(np.array([0, batch.num_rows], np.int32))
            columns = [pa.array([v], pa.int64()) for v in (unit, batch.num_rows, int((sizes > 0).sum()), int(sizes.sum()))]
            packs = (sizes, terms[first], np.append(first, len(terms)), rows.astype(np.int32), counts.astype(np.int32))
            names = ["unit", "n_docs", "n_with", "n_terms", "ids", "sizes", "terms", "starts", "docs", "counts"]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, batch["doc_id"]), *[pa.array([packed(p)], pa.binary()) for p in packs]], names=names)
            unit += 1

    schema = f"unit long, n_docs long, n_with long, n_terms long, ids array<{kind}>, sizes binary, terms binary, starts binary, docs binary, counts binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def holders(units: DataFrame) -> DataFrame:
    """``(term, df)``: the documents that hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, starts in zip(batch["terms"], batch["starts"], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms.as_py(), np.int64)), pa.array(np.diff(np.frombuffer(starts.as_py(), np.int64)))], names=["term", "n"])

    return units.select("terms", "starts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


def owned(units: DataFrame, owners, owner: int) -> DataFrame:
    """The units with only the postings that ``owner`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(4)]
            for terms, starts, docs, counts in zip(*(batch[c] for c in ("terms", "starts", "docs", "counts")), strict=True):
                terms, starts = np.frombuffer(terms.as_py(), np.uint64), np.frombuffer(starts.as_py(), np.int64)
                mine = owners.value[terms & np.uint64(len(owners.value) - 1)] == owner
                sizes = np.diff(starts)
                kept = np.repeat(mine, sizes)
                picked = terms[mine], np.concatenate([[0], np.cumsum(sizes[mine])]), np.frombuffer(docs.as_py(), np.int32)[kept], np.frombuffer(counts.as_py(), np.int32)[kept]
                for column, p in zip(out, picked, strict=True):
                    column.append(packed(p))
            yield pa.RecordBatch.from_arrays([batch["block"], batch["unit"], batch["ids"], batch["sizes"], *[pa.array(c, pa.binary()) for c in out]], names=["block", "unit", "ids", "sizes", "terms", "starts", "docs", "counts"])

    columns = units.select("block", "unit", "ids", "sizes", "terms", "starts", "docs", "counts")
    return columns.mapInArrow(run, columns.schema)


def norms(sizes: np.ndarray, n_with: int, n_terms: int) -> np.ndarray:
    """The length norm of each document, in whole per cent."""
    large = (SLOPE * int(sizes.max(initial=0)) * n_with) >> 63
    sizes = sizes.astype(object) if large else sizes
    return 100 - SLOPE + ((SLOPE * sizes * n_with) // max(1, n_terms)).astype(np.int64)


class Postings:
    """One owner's postings of one block: for each term, documents and what it gives them for a weight of 1."""

    def __init__(self, units: pa.Table, n_with: int, n_terms: int) -> None:
        units = units.sort_by("unit")
        column = lambda name, kind: [np.frombuffer(v.as_py(), kind) for v in units[name]]
        sizes = column("sizes", np.int64)
        base = np.cumsum([0, *map(len, sizes)])
        self.n_docs, norm = int(base[-1]), norms(np.concatenate(sizes), n_with, n_terms)
        docs = np.concatenate([d.astype(np.int64) + b for d, b in zip(column("docs", np.int32), base[:-1], strict=True)])
        counts = np.concatenate(column("counts", np.int32)).astype(np.int64)
        self.terms, number = np.unique(np.concatenate(column("terms", np.int64)), return_inverse=True)
        number = np.repeat(number, np.concatenate([np.diff(s) for s in column("starts", np.int64)]))
        order = np.argsort(number, kind="stable")
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(self.terms)))])
        self.docs = docs[order]
        self.gains = ((UNIT * counts) // (1000 * counts + 8 * norm[docs]))[order]

    def add(self, scores: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> None:
        at = np.searchsorted(self.terms, terms)
        for k, term, weight in zip(at.tolist(), terms.tolist(), weights.tolist(), strict=True):
            if k < len(self.terms) and self.terms[k] == term:
                low, high = self.starts[k], self.starts[k + 1]
                scores[self.docs[low:high]] += weight * self.gains[low:high]


def kth(values: np.ndarray, k: int) -> int:
    """The ``k``-th largest of the values, 0 if there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: for each item of ``items(item_id, text)`` its ``k`` best rows of ``docs(doc_id, text)``."""
    context = docs.sparkSession.sparkContext
    asked = written(item_terms(items))
    slot = F.col("term").bitwiseAND(SLOTS - 1)
    wanted = slot_table(asked.select(slot.alias("slot"), F.lit(0).alias("owner")).distinct(), SLOTS) >= 0
    units = written(index(docs, wanted))
    all_docs, n_with, n_terms = (int(v or 0) for v in units.agg(F.sum("n_docs"), F.sum("n_with"), F.sum("n_terms")).first())

    df = F.col("df")
    weight = F.floor(1000 * F.log((2.0 * n_with + 2) / (2 * df + 1))).cast("long")
    owner = F.lit(OWNERS - 1)
    for at, share in reversed(list(enumerate(SHARES))):
        owner = F.when(df * share < n_with, at).otherwise(owner)
    weighed = written(asked.join(written(holders(units)), "term").select("item_id", "term", (F.col("q") * weight).alias("weight"), owner.alias("owner")))
    owners = context.broadcast(slot_table(weighed.groupBy(slot.alias("slot")).agg(F.max("owner").alias("owner")), SLOTS))

    pairs = weighed.groupBy("item_id").agg(F.collect_list(F.struct("term", "weight")).alias("pairs"))
    bundles = written(pairs.select("item_id", F.col("pairs.term").alias("terms"), F.col("pairs.weight").alias("weights")))
    blocks, groups = parts(all_docs, BLOCK_DOCS), parts(bundles.count(), BUNDLE_ITEMS)
    units = units.withColumn("block", F.expr(f"pmod(xxhash64(unit), {blocks})"))
    cell = F.col("block") * groups + F.col("bundle")
    nothing = F.lit(b"")
    state = bundles.select("*", F.expr(f"pmod(xxhash64(item_id), {groups})").alias("bundle"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    state = state.select(cell.cast("long").alias("cell"), "item_id", "terms", "weights", nothing.alias("docs"), nothing.alias("scores"))
    for at in range(OWNERS):
        mine = owned(units, owners, at).withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        mine = mine.select(cell.cast("long").alias("cell"), "unit", *(["ids"] if at == OWNERS - 1 else []), "sizes", "terms", "starts", "docs", "counts")
        meet, schema = _stage(owners, at, k, n_with, n_terms, docs.schema["doc_id"].dataType, state)
        state = state.groupBy("cell").cogroup(mine.groupBy("cell")).applyInArrow(meet, schema)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return state.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _stage(owners, owner: int, k: int, n_with: int, n_terms: int, kind, state: DataFrame):
    """The function for one owner's groups, and the schema of its result: bundles that go on, or each item's best of a block."""
    last = owner == OWNERS - 1
    item = state.schema["item_id"].dataType.simpleString()
    schema = f"item_id {item}, doc_id {kind.simpleString()}, score long" if last else state.schema

    def meet(bundle: pa.Table, units: pa.Table) -> pa.Table:
        rows, docs_out, scores_out = [], [], []
        if bundle.num_rows and units.num_rows:
            postings = Postings(units, n_with, n_terms)
            scores = np.zeros(postings.n_docs, np.int64)
            for row, (terms, weights, docs, before) in enumerate(zip(*(bundle[c] for c in ("terms", "weights", "docs", "scores")), strict=True)):
                terms, weights = np.array(terms.as_py(), np.int64), np.array(weights.as_py(), np.int64)
                docs, before = np.frombuffer(docs.as_py(), np.int32), np.frombuffer(before.as_py(), np.int64)
                of = owners.value[terms & (len(owners.value) - 1)]
                scores[:] = 0
                scores[docs] = before
                # A document without a score so far cannot come in when all that is left is less than the k-th best has.
                shut = MOST * int(weights[of >= owner].sum()) < kth(before, k)
                postings.add(scores, terms[of == owner], weights[of == owner])
                met = docs if shut else np.flatnonzero(scores).astype(np.int32)
                after = scores[met]
                best = kth(after, k)
                kept = after + MOST * int(weights[of > owner].sum()) >= best
                rows.append(row)
                docs_out.append(met[kept])
                scores_out.append(after[kept])
        if not last:
            out = bundle.select(["cell", "item_id", "terms", "weights"]).take(pa.array(rows, pa.int64()))
            out = out.append_column("docs", pa.array([packed(d) for d in docs_out], pa.binary()))
            return out.append_column("scores", pa.array([packed(s) for s in scores_out], pa.binary()))
        found = np.repeat(np.array(rows, np.int64), [len(d) for d in docs_out])
        out = {"item_id": bundle["item_id"].take(pa.array(found))}
        if len(found):
            ids = pa.concat_arrays([c.flatten() for c in units.sort_by("unit")["ids"].chunks])
            out["doc_id"] = ids.take(pa.array(np.concatenate(docs_out)))
            out["score"] = pa.array(np.concatenate(scores_out))
        else:
            out["doc_id"], out["score"] = units["ids"].combine_chunks().flatten().slice(0, 0), pa.array([], pa.int64())
        return _best(pa.table(out), found, k)

    return meet, schema


def _best(found: pa.Table, rows: np.ndarray, k: int) -> pa.Table:
    """The first ``k`` of each row's documents by falling score, then by rising id."""
    found = found.append_column("_row", pa.array(rows))
    found = found.sort_by([("_row", "ascending"), ("score", "descending"), ("doc_id", "ascending")])
    rows = found["_row"].to_numpy()
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return found.filter(pa.array(place < k)).drop_columns("_row")
