"""Vectorised words and hashes over concatenated texts."""

from __future__ import annotations

import functools

import numpy as np

#: Odd multiplier of the rolling sums, and its inverse modulo 2**64.
PRIME = 0x9E3779B97F4A7C15
INVERSE = pow(PRIME, -1, 1 << 64)
_POWERS = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = np.array(x, dtype=np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt << 32)) * np.uint64(PRIME))


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[base][:n]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run ``values[start:end]`` that depends on nothing else."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(PRIME, len(values)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(INVERSE, len(values) + 1)[starts])


def run_bounds(keep: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and value number of each run of kept elements; runs end where a value ends."""
    first = keep.copy()
    first[1:] &= ~keep[:-1]
    last = keep.copy()
    last[:-1] &= ~keep[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(keep))]
    first[edges] = keep[edges]
    last[edges - 1] = keep[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = seeds(256, 1)


def byte_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, ...]:
    """Hash, start, end and value number of each word ``[^\\x20\\x09-\\x0D]+`` of UTF-8 texts; ``lower`` folds A-Z."""
    starts, ends, owner = run_bounds(~_SPACES[data], offsets)
    return run_hashes(_BYTES[_LOWER[data] if lower else data], starts, ends), starts, ends, owner


def windows(hashes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each ``size`` consecutive elements and where it starts, only where all belong to one value."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total *= np.uint64(PRIME)
        total += hashes[k : k + n]
    at = np.flatnonzero(owner[:n] == owner[size - 1 :])
    return mix(total[at]), at


@functools.cache
def letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: whether it is a letter, and its one-character lower case."""
    is_letter = np.zeros(0x110000, dtype=bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            is_letter[c] = True
            low = s.lower()
            if len(low) == 1:
                lower[c] = ord(low)
    return is_letter, lower


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts one after the other, and the offsets of each text."""
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return data, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
