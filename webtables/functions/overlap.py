"""Pairs of overlapping sets, two cells of rows against each other, in numpy.

A set is a list of hashed items. Its items are counted in cells by their low bits; the
items of one set that fall in cells which the other occupies are at least the items that
both share, so a matrix product bounds the shared items of all pairs of two blocks from
above. Pairs whose bound reaches the threshold are counted item by item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from webtables.functions.structure import flat

# Rows of a block, and cells of its dense form (16 MB).
BLOCK_ROWS, BLOCK_CELLS = 2048, 1 << 22


class _Side:
    """The rows ``at`` ordered by size, cut into blocks of bounded dense size."""

    def __init__(self, at: np.ndarray, values: np.ndarray, offsets: np.ndarray):
        self.at = at[np.argsort(np.diff(offsets)[at], kind="stable")]
        self.values, self.starts, self.sizes = values, offsets[:-1][self.at], np.diff(offsets)[self.at]
        self.blocks, a = [], 0
        while a < len(at):
            b = min(a + BLOCK_ROWS, len(at))
            while b - a > 1 and (b - a) * self.width(b - 1) > BLOCK_CELLS:
                b = a + (b - a) // 2
            self.blocks.append((a, b))
            a = b

    def width(self, row: int) -> int:
        """Cells for sets up to this row's size: a power of two, four times the items."""
        return max(256, 1 << (4 * int(self.sizes[row]) - 1).bit_length())

    def items(self, row: int) -> np.ndarray:
        return self.values[self.starts[row] : self.starts[row] + self.sizes[row]]

    def counts(self, a: int, b: int, width: int) -> np.ndarray:
        n = self.sizes[a:b]
        row = np.repeat(np.arange(b - a), n)
        at = np.arange(len(row)) + np.repeat(self.starts[a:b] - np.r_[0, np.cumsum(n)[:-1]], n)
        return np.bincount(row * width + (self.values[at] & (width - 1)), minlength=(b - a) * width).reshape(b - a, width)


def _pairs(x: _Side, y: _Side, at_least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    # shared >= at_least * union is shared >= need * (size + size)
    need = at_least / (1 + at_least)
    for i, (a, b) in enumerate(x.blocks):
        for c, d in y.blocks[i if x is y else 0 :]:
            if x.sizes[b - 1] < at_least * y.sizes[c] or y.sizes[d - 1] < at_least * x.sizes[a]:
                continue
            width = max(x.width(b - 1), y.width(d - 1))
            left = np.hstack([x.counts(a, b, width), -need * x.sizes[a:b, None], np.ones((b - a, 1))]).astype(np.float32)
            right = np.hstack([y.counts(c, d, width) > 0, np.ones((d - c, 1)), -need * y.sizes[c:d, None]]).astype(np.float32)
            hits = np.argwhere(left @ right.T > -0.01)  # more than single precision can err
            found = []
            for p, q in (hits + [a, c]).tolist():
                if x is y and p >= q:
                    continue
                shared = int(np.isin(x.items(p), y.items(q)).sum())
                if shared >= need * (x.sizes[p] + y.sizes[q]) - 1e-6:
                    found.append((p, q, shared))
            if found:
                p, q, shared = np.array(found).T
                yield x.at[p], y.at[q], shared


def overlapping(table: pa.Table, at_least: float) -> Iterator[pa.RecordBatch]:
    """Pairs of rows whose ``items`` (64-bit hashes of distinct things) have a Jaccard
    similarity of ``at_least`` or more, each once: of the rows with ``left`` and those
    without, or, if all have it, among them. As (group, one, other, shared, union)."""
    values, offsets = flat(table["items"].combine_chunks())
    left = table["left"].to_numpy().astype(bool)
    x = _Side(np.flatnonzero(left), values, offsets)
    y = x if left.all() else _Side(np.flatnonzero(~left), values, offsets)
    group, ids, sizes = table["group"].combine_chunks(), table["class_id"].combine_chunks(), np.diff(offsets)
    for p, q, shared in _pairs(x, y, at_least):
        cols = [group.take(pa.array(p)), ids.take(pa.array(p)), ids.take(pa.array(q)), pa.array(shared, pa.int32()), pa.array(sizes[p] + sizes[q] - shared, pa.int32())]
        yield pa.RecordBatch.from_arrays(cols, names=["group", "one", "other", "shared", "union"])
