"""Words of whole texts and Rabin-Karp hashes of word windows, in numpy.

A batch of texts is one array of bytes; no Python object is made per word. Word and
window hashes are 64-bit polynomials taken from prefix sums, so every window of any
length costs the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import raw

_rng = np.random.default_rng(20240607)  # fixed: hashes are alike in every task
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = {int(b): np.uint64(pow(int(b), -1, 1 << 64)) for b in (_BASE, _WORD_BASE)}
#: The white space of the contracts.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
#: All ASCII but letters and digits: words without punctuation.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1), modulo 2**64."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        with np.errstate(over="ignore"):
            while done < size:
                k = min(done, size - done)
                have[done : done + k] = have[:k] * np.uint64(pow(int(base), done, 1 << 64))
                done += k
        _POWERS[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers that spreads every bit (splitmix64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a column of texts (null: none).

    ``first[d]`` to ``first[d + 1]`` are the words of text d; ``start`` and ``end`` are
    their bytes in ``data``. ``blank``: other bytes that part words."""

    def __init__(self, col: pa.Array, lower: bool = False, blank: np.ndarray = _BLANK):
        self.data, off = raw(col)
        self.bounds = off  # of the texts' bytes
        solid = ~blank[self.data]
        if lower:
            self.hashed = _LOWER[self.data]
        else:
            self.hashed = self.data
        edge = np.zeros(len(solid) + 1, bool)
        edge[off] = True
        begins, ends = solid.copy(), solid
        begins[1:] &= ~solid[:-1] | edge[1:-1]
        self.start = np.flatnonzero(begins)
        last = ends.copy()
        last[:-1] &= ~ends[1:] | edge[1:-1]
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, off)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        with np.errstate(over="ignore"):
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE[self.hashed] * _powers(_BASE, len(self.data)), out=sums[1:])
            h = (sums[self.end] - sums[self.start]) * _powers(_INVERSE[int(_BASE)], len(self.data) + 1)[self.start]
        return mix(h)

    def windows(self, size: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the window of ``size`` words that starts at each word, and whether
        the window lies in one text."""
        h = self.hashes() if hashes is None else hashes
        n = len(h)
        if n < size:
            return np.zeros(n, np.uint64), np.zeros(n, bool)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(h * _powers(_WORD_BASE, n), out=sums[1:])
            out = np.zeros(n, np.uint64)
            k = n - size + 1
            out[:k] = mix((sums[size:] - sums[:k]) * _powers(_INVERSE[int(_WORD_BASE)], k))
        counts = np.diff(self.first)
        left = np.repeat(self.first[1:], counts) - np.arange(n)  # words from here to the text's end
        return out, left >= size

    def doc(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
