"""Words, hashes and n-grams of whole Arrow text columns with numpy.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``; A-Z are lower-cased on request and no
other character is changed. All functions work on blocks of about ``BLOCK`` bytes of text (one
longer text makes a block of its own), so memory does not follow the batch size.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 5  # odd, so powers never vanish modulo 2^64


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of splitmix64)."""
    h = h.astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(n - 1, 0), _BASE, np.uint64))), dtype=np.uint64)


@dataclass
class Block:
    """Texts ``lo`` to ``hi`` of a batch: word w of text i is at ``first[i] + w``."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lens = self.ends - self.starts
        begin = np.concatenate(([0], np.cumsum(lens)[:-1]))
        inside = np.arange(int(lens.sum())) - np.repeat(begin, lens)
        keep = ~_SPACE[self.data]
        values = (self.data[keep].astype(np.uint64) + np.uint64(1)) * _powers(int(lens.max()))[inside]
        return mix(np.add.reduceat(values, begin))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets and bytes of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offs, raw


def blocks(column, lower: bool = False, limit: int = BLOCK) -> Iterator[Block]:
    """The column in blocks of whole texts."""
    offs, raw = buffers(column)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        data = raw[offs[lo] : offs[hi]]
        own = offs[lo : hi + 1] - offs[lo]
        if lower:
            data = _LOWER[data]
        full = ~_SPACE[data]
        begin, end = full.copy(), full.copy()
        begin[1:] &= ~full[:-1]
        end[:-1] &= ~full[1:]
        cut = own[(own > 0) & (own < len(data))]
        begin[cut] = full[cut]
        end[cut - 1] = full[cut - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        yield Block(lo, hi, data, own, starts, ends, np.searchsorted(starts, own))
        lo = hi


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 positions have none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, p = np.zeros(n, np.uint64), _powers(k + 1)[1:]
    for i in range(k):
        out += h[i : i + n] * p[i]
    return mix(out)


def gram_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-grams of one text; a shorter text is one gram, an empty one has none."""
    if not len(h):
        return np.zeros(0, np.uint64)
    return np.unique(grams(h, min(k, len(h))))


def sequence_hash(h: np.ndarray) -> int:
    """One signed 64-bit hash of a whole sequence of hashes."""
    if not len(h):
        return 0
    with np.errstate(over="ignore"):
        total = np.add.reduce(h * _powers(len(h) + 1)[1:]) + np.uint64(len(h))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])
