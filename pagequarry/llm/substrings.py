"""Exact substring deduplication by fixed-block anchors.

Documents are cut into words. A passage is a window of ``size`` consecutive words. Every such window, wherever it
starts, holds a whole block of ``(size + 1) // 2`` words that begins at a multiple of that length in its document; these
non-overlapping blocks are the anchors. Every rolling window of the same length is a probe.

1. Probes meet anchors. Documents are dealt out in groups of a bounded number of rows, and a group sends each of its
   distinct probe hashes once, packed, however many of its documents hold it. A hash counts as shared when an anchor has
   it and another document has it too.
2. Shared probes are extended: every ``size``-word window around one is hashed whole (96 bits), and the smallest document
   that has it is found. Again a group sends each distinct hash once. Runs of repeated windows are the maximal repeats.
3. Each document drops the words of its windows that a smaller document has.

No two documents are paired, so a passage that a third of all documents share costs one row a group. Texts travel to
their group in each step; nothing refers to a row's place, so a recomputed task gives the same rows.

Defined results: a null or empty text has no words; a text shorter than a window loses nothing; repeated rows of one
``doc_id`` do not remove each other's words; a null ``doc_id`` removes and loses nothing; other columns are ignored, and
stay in :func:`drop_repeats`; an empty table gives an empty result. Texts of any length are read whole; groups follow
bytes as well as rows, so long texts make more groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm import base, text
from pagequarry.llm.base import written

#: Rows and bytes of a group, whichever makes more groups, and hashes that one task compares.
GROUP_ROWS, GROUP_BYTES, TASK_HASHES = 4096, 1 << 26, 1_500_000
#: Bits of a probe's hash that travel beside its bucket's.
PROBE_BITS = 46


def _grouped(docs: DataFrame, columns: list[str], groups: int, name: str = "_group") -> DataFrame:
    return docs.select(F.expr(f"CAST(pmod(xxhash64(doc_id, text), {groups}) AS INT)").alias(name), *columns).groupBy(name)


def _words(table: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of documents: numbers of the rows, bytes, word hashes, word starts and ends, word owners."""
    data, offsets = base.strings(table["text"].cast(pa.large_string()).combine_chunks())
    for low, high in base.runs(offsets):
        cut = offsets[low : high + 1] - offsets[low]
        here = data[offsets[low] : offsets[high]]
        yield np.arange(low, high), here, *text.byte_words(here, cut)


def _ids(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table["doc_id"].combine_chunks()
    return ids.fill_null(0).to_numpy().astype(np.int64), ids.is_valid().to_numpy(zero_copy_only=False)


def _joined(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _planes(values: np.ndarray) -> bytes:
    """Sorted 48-bit numbers byte by byte, high bytes first, so that shuffles compress them."""
    return np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].T).tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(6, -1).T
    return out.view(">u8").reshape(-1).astype(np.uint64)


def _long_windows(hashes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64 and 32 more bits of each window's hash, and where it starts."""
    one, at = text.windows(hashes, owner, size)
    two, _ = text.windows(hashes ^ np.uint64(0x5851F42D4C957F2D), owner, size)
    return one, (two >> np.uint64(32)).astype(np.uint32), at


def repeats(docs: DataFrame, size: int = 13) -> tuple[DataFrame, int]:
    """``(_group, first, second, least)`` packed: windows each group must know, with the smallest document; and the groups."""
    anchor = (size + 1) // 2
    shape = docs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    groups = max(base.parts(shape["rows"], GROUP_ROWS), base.parts(shape["bytes"], GROUP_BYTES))
    bits = max(1, base.parts(shape["bytes"] // 5, TASK_HASHES).bit_length())
    bits = min(bits, 18)
    shift, buckets = np.uint64(64 - PROBE_BITS - bits), 1 << bits

    def slices(buckets_of: np.ndarray) -> Iterator[tuple[int, int, int]]:
        bounds = np.searchsorted(buckets_of, np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(bounds)):
            yield int(k), int(bounds[k]), int(bounds[k + 1])

    def probes(key: tuple, table: pa.Table) -> pa.Table:
        """A group's distinct probes: hash, whether two documents have it, whether it is an anchor here."""
        ids, valid = _ids(table)
        got = []
        for rows, _, hashes, _, _, owner in _words(table):
            found, at = text.windows(hashes, owner, anchor)
            ok = valid[rows[owner[at]]]
            first = np.searchsorted(owner, owner[at])
            got.append((found[ok], ids[rows[owner[at]]][ok], ((at - first) % anchor == 0)[ok]))
        found, of, anchored = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, d) for k, d in enumerate((np.uint64, np.int64, bool)))
        found >>= shift
        order = np.argsort(found)
        found, of, anchored = found[order], of[order], anchored[order]
        new = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
        many = np.minimum.reduceat(of, new) != np.maximum.reduceat(of, new) if len(new) else np.zeros(0, bool)
        marked = np.logical_or.reduceat(anchored, new) if len(new) else many
        found = found[new]
        value = ((found & np.uint64((1 << PROBE_BITS) - 1)) << np.uint64(2)) | (many.astype(np.uint64) << np.uint64(1)) | marked.astype(np.uint64)
        rows = [(b, _planes(value[i:j])) for b, i, j in slices(found >> np.uint64(PROBE_BITS))]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "_group": pa.array([key[0].as_py()] * len(rows), pa.int32()), "payload": pa.array([r[1] for r in rows], pa.binary())})

    def shared(key: tuple, table: pa.Table) -> pa.Table:
        """What each group must know of one bucket: the hashes that an anchor and another document have."""
        parts = [_unplanes(p) for p in table["payload"].to_pylist()]
        group = np.repeat(table["_group"].to_numpy(), [len(p) for p in parts])
        value = np.concatenate(parts)
        order = np.argsort(value >> np.uint64(2))
        value, group = value[order], group[order]
        found = value >> np.uint64(2)
        new = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        size_ = np.diff(np.append(new, len(found)))
        flags = np.bitwise_or.reduceat(value & np.uint64(3), new)
        good = ((flags & np.uint64(1)) > 0) & ((size_ > 1) | (flags > np.uint64(1)))
        keep = np.repeat(good, size_)
        found, group = found[keep], group[keep]
        order = np.lexsort((found, group))
        found, group = found[order], group[order]
        names, at = np.unique(group, return_index=True)
        cut = [_planes(found[i:j]) for i, j in zip(at, np.append(at[1:], len(found))[: len(at)], strict=True)]
        return pa.table({"_group": pa.array(names.astype(np.int32)), "bucket": pa.array([key[0].as_py()] * len(names), pa.int32()), "payload": pa.array(cut, pa.binary())})

    sent = _grouped(docs, ["doc_id", "text"], groups).applyInArrow(probes, "bucket int, _group int, payload binary")
    hits = written(sent.groupBy("bucket").applyInArrow(shared, "_group int, bucket int, payload binary"))

    def extend(key: tuple, table: pa.Table, known: pa.Table) -> pa.Table:
        """A group's distinct windows around shared probes, with the smallest document and whether there are more."""
        ids, valid = _ids(table)
        wanted = [_unplanes(p) | (np.uint64(b) << np.uint64(PROBE_BITS)) for b, p in zip(known["bucket"].to_pylist(), known["payload"].to_pylist(), strict=True)]
        wanted = np.sort(np.concatenate(wanted)) if wanted else np.zeros(0, np.uint64)
        got = []
        for rows, _, hashes, _, _, owner in _words(table) if len(wanted) else ():
            found, at = text.windows(hashes, owner, anchor)
            hit = np.zeros(len(hashes) + size, np.int32)
            hit[at] = _among(found >> shift, wanted)
            near = np.cumsum(np.concatenate([[0], hit]))
            one, two, at = _long_windows(hashes, owner, size)
            ok = (near[at + size - anchor + 1] > near[at]) & valid[rows[owner[at]]]
            got.append((one[ok], two[ok], ids[rows[owner[at]]][ok]))
        one, two, of = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, d) for k, d in enumerate((np.uint64, np.uint32, np.int64)))
        order, new = _sorted_groups(one, two)
        of = of[order]
        least, most = (f.reduceat(of, new) if len(new) else of for f in (np.minimum, np.maximum))
        one, two = one[order][new], two[order][new]
        rows = [(b, base.packed(one[i:j]), base.packed(two[i:j]), base.packed(least[i:j]), base.packed(least[i:j] < most[i:j])) for b, i, j in slices(one >> np.uint64(64 - bits))]
        columns = {name: pa.array([r[k] for r in rows], pa.int32() if name == "bucket" else pa.binary()) for k, name in enumerate(("bucket", "first", "second", "least", "more"))}
        return pa.table({"bucket": columns.pop("bucket"), "_group": pa.array([key[0].as_py()] * len(rows), pa.int32()), **columns})

    def smallest(key: tuple, table: pa.Table) -> pa.Table:
        """For each group the windows of one bucket that it has in a document larger than the smallest one."""
        one, two, least, more = (_joined(table[c], d) for c, d in (("first", np.uint64), ("second", np.uint32), ("least", np.int64), ("more", bool)))
        group = np.repeat(table["_group"].to_numpy(), [len(p) // 8 for p in table["first"].to_pylist()])
        order, new = _sorted_groups(one, two)
        best = np.repeat(np.minimum.reduceat(least[order], new), np.diff(np.append(new, len(order)))) if len(new) else least
        one, two, own, more, group = one[order], two[order], least[order], more[order], group[order]
        keep = (best < own) | more
        one, two, best, group = one[keep], two[keep], best[keep], group[keep]
        order = np.argsort(group, kind="stable")
        names, at = np.unique(group[order], return_index=True)
        ends = np.append(at[1:], len(order))[: len(at)]
        cut = lambda v: pa.array([base.packed(v[order[i:j]]) for i, j in zip(at, ends, strict=True)], pa.binary())
        return pa.table({"_group": pa.array(names.astype(np.int32)), "first": cut(one), "second": cut(two), "least": cut(best)})

    met = _grouped(docs, ["doc_id", "text"], groups).cogroup(hits.groupBy("_group"))
    grown = met.applyInArrow(extend, "bucket int, _group int, first binary, second binary, least binary, more binary")
    return written(grown.groupBy("bucket").applyInArrow(smallest, "_group int, first binary, second binary, least binary")), groups


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted ``known``."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def _sorted_groups(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by both parts of the hash, and where each distinct hash begins in it."""
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    return order, np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)


def _removed(table: pa.Table, known: pa.Table, size: int) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """For each row its number, bytes, word starts, word ends, and which words go."""
    ids, valid = _ids(table)
    one, two, least = (_joined(known[c], d) for c, d in (("first", np.uint64), ("second", np.uint32), ("least", np.int64)))
    order = np.lexsort((two, one))
    one, two, least = one[order], two[order], least[order]
    for rows, data, hashes, starts, ends, owner in _words(table):
        gone = np.zeros(len(hashes) + 1, np.int64)
        if len(one):
            a, b, at = _long_windows(hashes, owner, size)
            place = np.searchsorted(one, a)
            # Windows whose first 64 bits agree but not the other 32 stand next to each other.
            ok = np.zeros(len(a), bool)
            left = np.flatnonzero(place < len(one))
            left = left[one[place[left]] == a[left]]
            while len(left):
                same = two[place[left]] == b[left]
                ok[left[same]] = least[place[left[same]]] < ids[rows[owner[at[left[same]]]]]
                left = left[~same]
                place[left] += 1
                left = left[place[left] < len(one)]
                left = left[one[place[left]] == a[left]]
            ok &= valid[rows[owner[at]]]
            np.add.at(gone, at[ok], 1)
            np.subtract.at(gone, at[ok] + size, 1)
        gone = np.cumsum(gone)[:-1] > 0
        bounds = np.searchsorted(owner, np.arange(len(rows) + 1))
        for k, row in enumerate(rows):
            i, j = bounds[k], bounds[k + 1]
            yield int(row), data, starts[i:j], ends[i:j], gone[i:j]


def digests(docs: DataFrame, size: int = 13) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)``: kept words joined by one space."""
    known, groups = repeats(docs, size)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(key: tuple, table: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        for _, data, starts, ends, gone in _removed(table, known, size):
            kept = [data[i:j].tobytes() for i, j in zip(starts[~gone], ends[~gone], strict=True)]
            out.append((len(gone), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
        columns = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
        return pa.Table.from_arrays([table["doc_id"], *columns], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    met = _grouped(docs, ["doc_id", "text"], groups).cogroup(known.groupBy("_group"))
    return met.applyInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def drop_repeats(docs: DataFrame, size: int = 13) -> DataFrame:
    """``docs`` with every column, repeated words cut out of ``text`` with the blanks behind them; a text without any stays as it is."""
    known, groups = repeats(docs, size)
    group = base.free_name(docs, "_group")

    def run(key: tuple, table: pa.Table, known: pa.Table) -> pa.Table:
        table = table.drop_columns([group])
        whole = table["text"].cast(pa.large_string()).combine_chunks().to_pylist()
        for row, data, starts, ends, gone in _removed(table, known, size):
            if gone.any():
                # Each kept word goes out with the blanks that follow it; what stood before the first word stays too.
                stops = np.append(starts[1:], 0)
                raw = whole[row].encode()
                shift = len(raw)
                first = starts[0] - (len(raw) - len(raw.lstrip(b" \t\n\v\f\r")))
                stops[-1] = first + shift
                whole[row] = (raw[: starts[0] - first] + b"".join(raw[i - first : j - first] for i, j in zip(starts[~gone], stops[~gone], strict=True))).decode()
        return table.set_column(table.column_names.index("text"), "text", pa.array(whole, table.schema.field("text").type))

    met = _grouped(docs, docs.columns, groups, group).cogroup(known.groupBy("_group"))
    return met.applyInArrow(run, docs.schema)
