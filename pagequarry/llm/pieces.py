"""SentencePiece encoding and decoding with forward states shared between words.

A text is marked as the vocabulary wants it (blanks become ``▁``, one is put in front) and cut where no piece can reach
across: before each run of ``▁``, around line ends, and before marks that follow a letter in no piece. The distinct marked words of a batch are sorted, which is a
depth-first walk of their trie: what the forward pass found for a common beginning is kept for the next word.

The forward pass holds, for every beginning of a word, its best segmentation's last piece and where that piece begins. For a vocabulary of merges (the kind given here) the best segmentation is the one that merging by
score leaves: a piece may follow another if merging the two together keeps them apart, and exactly one piece can end a
given beginning. (The path with the largest sum of scores would differ from the library's ids, so it is not used.)
Characters without a piece become their UTF-8 bytes.

Defined results: null and empty texts have no ids and decode to an empty text; repeated rows are encoded each; a null
``doc_id`` stays null; other columns are ignored; whole texts of any length are encoded; an empty table gives an empty result. ``▁`` in a text decodes to a
blank, as the vocabulary cannot tell them apart.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
_WORDS = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
#: Words whose ids a worker remembers before it begins a new generation; of the generation before, words in use stay.
CACHE = 350_000


class Pieces:
    """A vocabulary of merges with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.raw: list[bytes] = []
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.bytes[int(piece[3:-1], 16)] = k
                self.raw.append(bytes([int(piece[3:-1], 16)]))
            elif model.is_control(k) or model.is_unknown(k):
                self.raw.append(b"")
            else:
                self.scores[piece], self.ids[piece] = model.get_score(k), k
                self.raw.append(piece.replace(MARK, " ").encode())
        self.good = {p for p in self.ids if self.merged(p) == [p]}
        # How long the pieces are that end in two or three given characters, longest first.
        lengths: dict[str, set[int]] = {}
        for piece in self.good:
            for n in (2, 3):
                if len(piece) >= n:
                    lengths.setdefault(piece[-n:], set()).add(len(piece))
        for end in [e for e in lengths if len(e) == 3]:
            lengths[end] |= {n for n in lengths.get(end[1:], ()) if n == 2}
        self.lengths = {k: (*sorted(v, reverse=True), 1) for k, v in lengths.items() if len(k) == 3}
        self.pairs = {k: (2, 1) for k in lengths if len(k) == 2 and k in self.good}
        after_letter = {b for piece in self.ids for a, b in zip(piece, piece[1:], strict=False) if a.isalpha()}
        marks = re.escape("".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in after_letter))
        self.seam = re.compile(f"(?<=[^\\W\\d_])(?=[{marks}])")
        self.flat: np.ndarray | None = None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.apart = functools.lru_cache(1 << 17)(lambda a, b: self.merged(a + b) == [a, b])

    def merged(self, word: str) -> list[str]:
        """Pieces of a short word by merging: the best score first, the leftmost of equals."""
        parts = list(word)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _unknown(self, words: set[str]) -> set[str]:
        """The words that are in neither generation; those of the older one move to the newer one."""
        missing = words - self.known.keys()
        kept = missing & self.older.keys()
        self.known.update(zip(kept, map(self.older.__getitem__, kept), strict=True))
        return missing - kept

    def learn(self, words: set[str]) -> None:
        """Ids of all the words: one sorted walk over the parts that are not known yet."""
        if len(self.known) + len(words) > CACHE:
            self.older, self.known = self.known, {}
        cut = {w: self.seam.split(w) for w in self._unknown(words)}
        self._walk(self._unknown({part for parts in cut.values() for part in parts}))
        known = self.known
        known.update((w, b"".join(map(known.__getitem__, parts))) for w, parts in cut.items() if len(parts) > 1)

    def _walk(self, words: set[str]) -> None:
        last, begin = [""], [0]
        before, single = "", (1,)
        lengths, pairs, good, apart, ids, parts = self.lengths.get, self.pairs.get, self.good, self.apart, self.ids.get, self.known
        for word in sorted(words):
            same, most = 0, min(len(before), len(word))
            while same < most and before[same] == word[same]:
                same += 1
            del last[same + 1 :], begin[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                sizes = lengths(word[end - 3 : end]) if end > 2 else None
                for size in sizes or (pairs(word[end - 2 : end], single) if end > 1 else single):
                    start = end - size
                    if start < 0:
                        continue
                    piece = word[start:end]
                    if (size == 1 or piece in good) and (not start or apart(last[start], piece)):
                        break
                last.append(piece)
                begin.append(start)
            out = array("i")
            end = len(word)
            while end:
                found = ids(last[end])
                if found is not None:
                    out.append(found)
                else:
                    out.extend(self.bytes[b] for b in reversed(last[end].encode("utf-8", "surrogatepass")))
                end = begin[end]
            out.reverse()
            parts[word] = out.tobytes()
            before = word

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as the bytes of 32-bit numbers."""
        cut = [_WORDS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        self.learn(set().union(*cut))
        return [b"".join(map(self.known.__getitem__, words)) for words in cut]

    def forget(self) -> None:
        """Give back the memory of words and seams."""
        self.known, self.older = {}, {}
        self.apart.cache_clear()

    def raw_bytes(self, ids: np.ndarray) -> np.ndarray:
        """UTF-8 bytes of all the ids, one piece after the other."""
        if self.flat is None:
            self.flat = np.frombuffer(b"".join(self.raw), np.uint8)
            self.sizes = np.array([len(r) for r in self.raw])
            self.starts = np.cumsum(self.sizes) - self.sizes
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the blank put in front."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


@functools.cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _runs(texts: list[str], most: int = 1 << 21) -> Iterator[list[str]]:
    some: list[str] = []
    size = 0
    for one in texts:
        if some and size + len(one) > most:
            yield some
            some, size = [], 0
        some.append(one)
        size += len(one)
    if some:
        yield some


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = (), remember: bool = False) -> DataFrame:
    """``(doc_id, *keep, n_tokens, ids)`` of each text by the vocabulary file at ``path``.

    Workers outlive their tasks. With ``remember`` they keep the words they know for the next task, which suits a job that
    only encodes; without it they give the memory back to whatever runs next.
    """
    columns = ["doc_id", *keep]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + ", n_tokens long, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, ids in _encoded(batches, pieces(path)):
            sizes = np.diff(np.asarray(ids.offsets)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(part[c] for c in columns), pa.array(sizes), ids], names=[*columns, "n_tokens", "ids"])
        if not remember:
            pieces(path).forget()

    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` of the ids of each row of ``encoded(doc_id, ids)``."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(path)
        for batch in batches:
            texts = [vocabulary.decode(ids or []) for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def encode_and_check(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, same)``: ids of each text, and whether they decode to it. Workers remember their words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(path)
        for texts, part, ids in _encoded(batches, vocabulary):
            bounds = np.asarray(ids.offsets)
            raw = vocabulary.raw_bytes(np.asarray(ids.values)).tobytes()
            wanted = [b" " + t.replace(MARK, " ").encode("utf-8", "surrogatepass") if t else b"" for t in texts]
            same = [True] * len(texts)
            if raw != b"".join(wanted):  # then text by text
                values = np.asarray(ids.values)
                same = [vocabulary.raw_bytes(values[a:b]).tobytes() == w for a, b, w in zip(bounds[:-1], bounds[1:], wanted, strict=True)]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(np.diff(bounds).astype(np.int64)), ids, pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids", "same"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, same boolean")


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: Pieces) -> Iterator[tuple[list[str], pa.RecordBatch, pa.ListArray]]:
    """Runs of texts, their rows, and their ids."""
    for batch in batches:
        at = 0
        for texts in _runs([t or "" for t in batch["text"].to_pylist()]):
            found = vocabulary.encode(texts)
            offsets = np.concatenate([[0], np.cumsum([len(f) // 4 for f in found])]).astype(np.int32)
            yield texts, batch.slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))
            at += len(texts)
