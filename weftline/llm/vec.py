"""Whole-batch text work with numpy: word bounds, word hashes and window hashes without a Python loop over words.

All functions take slices of Arrow string arrays, of ``SLICE`` bytes of text at most unless one text alone is
longer, so memory in a Python worker stays bounded whatever the batch holds.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 2 << 20
BASE = 0x9E3779B97F4A7C15 | 1
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Neither an ASCII letter or digit nor part of a non-ASCII character.
NOT_ALNUM = np.array([b < 0x80 and not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A) for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SAME = np.arange(256, dtype=np.uint8)


def worker_cache() -> dict:
    """What one Python process keeps from task to task. It hangs on ``sys``, so it never travels with a pickled function."""
    return sys.__dict__.setdefault("_weftline_cache", {})


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    tables = worker_cache()
    have = tables.get("up")
    if have is None or len(have) < n:
        size = max(n, SLICE + 1)
        for key, x in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, x, np.uint64)
            steps[0] = 1
            tables[key] = np.multiply.accumulate(steps)
    return tables["up"][:n], tables["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and n + 1 offsets; a null is an empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    if len(texts) == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offs = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of ``most`` bytes at most, or of one row."""
    _, offs = flat(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, min(hi, len(texts))
        lo = hi


@dataclass
class Words:
    """Words of some texts. ``low``: the bytes, folded; start and end of each word in it, and its text's number."""

    low: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    n: np.ndarray

    def hashes(self) -> np.ndarray:
        up, down = powers(len(self.low) + 1)
        sums = np.zeros(len(self.low) + 1, np.uint64)
        np.cumsum((self.low.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def word(self, i: int) -> bytes:
        return self.low[self.start[i] : self.end[i]].tobytes()

    def compact(self) -> tuple[np.ndarray, np.ndarray]:
        """The words' bytes end to end, and n + 1 offsets."""
        size = self.end - self.start
        offs = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=offs[1:])
        return self.low[spans(self.start, size)], offs


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ..., start[0]+size[0]-1, start[1], ..."""
    offs = np.cumsum(size) - size
    return np.arange(int(size.sum()), dtype=np.int64) + np.repeat(start - offs, size)


def words(texts: pa.Array, sep: np.ndarray = SPACE, fold: np.ndarray = LOWER) -> Words:
    raw, offs = flat(texts)
    inside = ~sep[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    at = offs[:-1][offs[:-1] < offs[1:]]
    first[at] = inside[at]
    at = offs[1:][offs[:-1] < offs[1:]] - 1
    last[at] = inside[at]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(offs, start, "right") - 1
    return Words(fold[raw], start, end, doc, np.bincount(doc, minlength=len(texts)))


def windows(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k consecutive items within one text, and the number of its first item."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out * np.uint64(BASE) + h[j : j + n]
    return mix(out[at]), at
