"""Whole batches of texts as numpy arrays of code points: classes, words and rolling hashes.

Texts of a batch lie one after another in one array; `bounds` holds where each begins, and the end.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

#: Code points handled at a time; a longer text makes a batch of its own.
BATCH_CHARS = 500_000
LIMIT = 0x110000
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Odd multiplier of the rolling hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)


def slices(texts: Sequence[str], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `limit` code points each."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, bounds) of all texts."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), bounds


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point, whether it is a letter (category L)."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(LIMIT)), bool, LIMIT)


@lru_cache(1)
def lower_points() -> np.ndarray:
    """Simple lower case of each code point; those that lower to several stay as they are."""
    low = np.arange(LIMIT, dtype=np.uint32)
    for c in range(LIMIT):
        x = chr(c).lower()
        if len(x) == 1:
            low[c] = ord(x)
    return low


@lru_cache(1)
def spaces() -> np.ndarray:
    """For each code point, whether str.isspace holds."""
    return np.fromiter((chr(c).isspace() for c in range(LIMIT)), bool, LIMIT)


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of each maximal run where `inside` holds within one text."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = heads[1:] - 1
    last[tails] = inside[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(bounds, start, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, BASE, np.uint64), np.full(n + 1, BASE_INV, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Rolling:
    """Hashes of any ranges of an array of code points, from one prefix sum."""

    def __init__(self, values: np.ndarray):
        n = 1 << max(16, int(len(values)).bit_length())
        up, self.down = _powers(n)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        """Hash of each range; equal contents have equal hashes, and length and salt count."""
        own = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(own + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(salt * 0x632BE59BD9B4E019 & (1 << 64) - 1))
