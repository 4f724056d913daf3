"""Exact token counts of byte-level BPE by prefix dynamic programming.

A text is cut into pieces by the vocabulary's pattern; merges never cross pieces. Inside a piece, the encoding of each
prefix is that of a shorter prefix plus one last token, and the right last token is the only one that the merges leave
apart from the token before it. So one pass over a piece gives the count at every prefix, and running sums over pieces
give it for the text. Stored, they answer how many tokens a prefix has and where a budget ends, without encoding again.

Defined results: null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; a null ``doc_id`` stays
null; other columns of the input are ignored; an empty table gives an empty result. Texts of any length are counted
whole. A special token's string inside a text is one token, as the tokenizer's default has it.
"""

from __future__ import annotations

import functools
import json
from array import array
from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pagequarry.llm.base import runs

#: How byte-level vocabularies cut a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What the pattern cuts in another way when the text ends inside.
BLANKS = regex.compile(r"\s{2,}+")
#: Characters whose prefix counts a worker holds at a time; a longer text is held alone.
RUN_CHARS = 1 << 21
#: Pieces whose counts a worker remembers before it starts over, and the most characters of one.
CACHE, LONGEST = 600_000, 64


class Merges:
    """A BPE vocabulary as merges: which two tokens made a token, and when."""

    def __init__(self, ids: dict[bytes, int], pairs: list[tuple[bytes, bytes]]) -> None:
        self.ids = ids
        #: The longest token with each last three bytes.
        self.reach: dict[bytes, int] = {}
        for token in ids:
            if len(token) > 2:
                self.reach[token[-3:]] = max(len(token), self.reach.get(token[-3:], 2))
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for at, (left, right) in enumerate(pairs):
            pair, token = (ids[left], ids[right]), ids[left + right]
            self.rank.setdefault(pair, at)
            self.made.setdefault(token, (at, *pair))
        self.apart = functools.lru_cache(1 << 18)(self._apart)

    def _apart(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens side by side: no merge across the seam comes before both are whole."""
        bound = None
        while True:
            at = self.rank.get((left, right))
            if at is not None and (bound is None or at < bound):
                return False
            a, b = self.made.get(left), self.made.get(right)
            # Undo the later of the two merges: before it, its inner part stood at the seam.
            if a is not None and (b is None or a[0] > b[0]):
                bound, left = a[0], a[2]
            elif b is not None:
                # The right token's merge at the same rank runs after a merge to its left, so it is no barrier then.
                bound, right = b[0] + 1, b[1]
            else:
                return True

    def extend(self, piece: bytes, counts: list[int], last: list[int]) -> None:
        """Carry on from the first bytes of ``piece``: tokens of ``piece[:i]`` and the last of them, for every ``i``."""
        find, apart, reach = self.ids.get, self.apart, self.reach.get
        for end in range(len(counts), len(piece) + 1):
            # No token that ends with these three bytes is longer than ``reach``.
            far = end - reach(piece[end - 3 : end], 2) if end > 2 else 0
            for start in range(far if far > 0 else 0, end):
                token = find(piece[start:end])
                if token is not None and (not start or (last[start] >= 0 and apart(last[start], token))):
                    last.append(token)
                    counts.append(counts[start] + 1)
                    break
            else:
                last.append(-1)
                counts.append(0)


@functools.cache
def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, and back."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(rest)}}


class Counter(dict):
    """How the count changes with each character of a piece, as packed 32-bit numbers.

    :meth:`learn` keeps the pieces of many texts at once; any other piece is worked out when asked for.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        names = byte_names()
        raw = lambda s: bytes(names[c] for c in s)
        model = spec["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        specials = [t["content"] for t in spec["added_tokens"]]
        ids = {raw(k): v for k, v in model["vocab"].items() if k not in specials}
        self.merges = Merges(ids, [(raw(a), raw(b)) for a, b in pairs])
        self.pieces = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) or r"(?!)")

    def learn(self, pieces: Iterable[str]) -> None:
        """Work out unknown pieces in sorted order: each takes over the prefix it shares with the one before it."""
        new = sorted(p for p in pieces if p not in self and len(p) <= LONGEST)
        before, counts, last = b"", [0], [-1]
        if len(self) + len(new) > CACHE:
            self.clear()
        for piece in new:
            coded = piece.encode("utf-8", "surrogatepass")
            same, most = 0, min(len(coded), len(before))
            while same < most and coded[same] == before[same]:
                same += 1
            del counts[same + 1 :], last[same + 1 :]
            self.merges.extend(coded, counts, last)
            self[piece] = self._steps(piece, len(coded), counts)
            before = coded

    def __missing__(self, piece: str) -> bytes:
        coded, counts = piece.encode("utf-8", "surrogatepass"), [0]
        self.merges.extend(coded, counts, [-1])
        return self._steps(piece, len(coded), counts)

    def _steps(self, piece: str, n_bytes: int, counts: list[int]) -> bytes:
        if piece in ("'re", "'ve", "'ll"):
            counts = [0, 1, 2, counts[-1]]  # cut inside, it is two pieces
        elif n_bytes > len(piece):  # only the counts where a character ends
            ends = accumulate((len(c.encode("utf-8", "surrogatepass")) for c in piece), initial=0)
            counts = [counts[end] for end in ends]
        return array("i", map(sub, counts[1:], counts)).tobytes()

    def plain_spans(self, text: str) -> Iterator[tuple[int, int, bool]]:
        """Spans of the text and whether each is a special token."""
        at = 0
        for m in self.special.finditer(text):
            if m.start() > at:
                yield at, m.start(), False
            yield m.start(), m.end(), True
            at = m.end()
        if at < len(text):
            yield at, len(text), False

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        if "<|" not in text or not self.special.search(text):
            return self._count(text)
        return sum(1 if special else self._count(text[a:b]) for a, b, special in self.plain_spans(text))

    def _count(self, text: str) -> int:
        if len(text) < 1 << 20:
            return sum(array("i", b"".join(map(self.__getitem__, self.pieces.findall(text)))))
        return sum(sum(array("i", self[m.group()])) for m in self.pieces.finditer(text))

    def prefix_counts(self, text: str, cut: list[str] | None = None) -> np.ndarray:
        """Tokens of ``text[:n]`` for every ``n`` from 0; ``cut`` are the pieces of the text, where they are known."""
        counts = np.zeros(len(text) + 1, np.int32)
        if "<|" not in text or not self.special.search(text):
            self._prefix_counts(text, 0, counts, cut)
            return counts
        before = base = 0
        for a, b, special in self.plain_spans(text):
            if special:
                # A cut token is plain text and joins what stands before it, from the start of the last piece.
                for n in range(a + 1, b):
                    counts[n] = base + self.count(text[before:n])
                counts[b] = counts[a] + 1
                before, base = b, counts[b]
            else:
                last = self._prefix_counts(text[a:b], a, counts)
                before, base = b - len(last), counts[b] - sum(array("i", self[last]))
        return counts

    def _prefix_counts(self, text: str, start: int, counts: np.ndarray, cut: list[str] | None = None) -> str:
        """Fill ``counts`` after ``start`` for ``text``, which stands there and has no special token; its last piece."""
        found = self.pieces.findall(text) if cut is None else cut
        steps = np.frombuffer(b"".join(map(self.__getitem__, found)), np.int32)
        np.cumsum(steps, out=counts[start + 1 : start + len(text) + 1])
        counts[start + 1 : start + len(text) + 1] += counts[start]
        # Cut inside, a run of blanks is one piece.
        for m in BLANKS.finditer(text):
            a, b = start + m.start(), start + m.end()
            counts[a + 1 : b + 1] = counts[a] + np.cumsum(np.frombuffer(self[m.group()], np.int32))
        return found[-1] if found else ""

    def prefixes(self, text: str) -> tuple[Sequence[int], np.ndarray]:
        """The length of each prefix but the empty one, in characters, and its tokens."""
        return range(1, len(text) + 1), self.prefix_counts(text)[1:]

    def at(self, text: str, ends: Sequence[int], counts: Sequence[int], n: int) -> int:
        """Tokens of ``text[:n]`` from the stored prefixes."""
        n = max(0, min(n, len(ends)))
        return int(counts[n - 1]) if n else 0

    def budget(self, ends: Sequence[int], counts: Sequence[int], tokens: int) -> int:
        """Characters of the longest prefix that takes up to ``tokens`` tokens. Counts can fall, so the last one decides."""
        fits = np.flatnonzero(np.asarray(counts) <= tokens)
        return int(ends[fits[-1]]) if len(fits) else 0


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, prefixes: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of each text by the vocabulary file at ``path``.

    With ``prefixes`` also ``piece_tokens``, the tokens of the first 1, 2, ... characters, up to the whole text, for
    :meth:`Counter.at` and :meth:`Counter.budget`.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    schema += ", piece_tokens array<int>" if prefixes else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            for low, high in runs(np.cumsum([0, *map(len, texts)]), RUN_CHARS):
                some = texts[low:high]
                cut = [tokens.pieces.findall(t) for t in some]
                tokens.learn(set().union(*cut))
                found = [tokens.prefix_counts(t, c) for t, c in zip(some, cut, strict=True)] if prefixes else []
                counts = [int(f[-1]) for f in found] if prefixes else [tokens.count(t) for t in some]
                columns = [
                    batch["doc_id"].slice(low, high - low),
                    pa.array([len(t.encode("utf-8", "surrogatepass")) for t in some], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([c > limit for c in counts], pa.bool_()),
                ]
                if prefixes:
                    ends = np.cumsum([0, *map(len, some)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([f[1:] for f in found]))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit", "piece_tokens"][: len(columns)])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
