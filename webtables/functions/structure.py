"""Structural joins over the pages of an Arrow batch, in numpy.

Nodes are intervals (``id`` to ``end_id``) in pre-order. One pass with a running maximum of
the marked nodes' ends, which is what the stack of open marked nodes comes to, tells for
every node whether a marked one is above it; sibling steps look up one index. So a selector
costs a few passes over the nodes whatever their depth, and no pair is formed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_FAR = np.int64(1) << 32


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column (null lists: none; null values: -1 or false) and the
    rows' offsets."""
    lists = pa.concat_arrays([lists]) if lists.offset else lists
    values = lists.flatten()
    size = np.zeros(len(lists), np.int64)
    got = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    size[:] = got
    if values.null_count:
        values = values.fill_null(False if pa.types.is_boolean(values.type) else -1)
    return values.to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(size)]


def covered(ends: np.ndarray, marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a marked node lies above each node of whole pages."""
    n = len(ends)
    if not n:
        return np.zeros(0, bool)
    page = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ids = np.arange(n) - offsets[page]
    reach = np.maximum.accumulate(np.where(marks, ends.astype(np.int64), -1) + page * _FAR)
    return np.r_[np.int64(-1), reach[:-1]] >= ids + page * _FAR


def nearest(parents: np.ndarray, marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The id of the nearest marked node above each node of whole pages, -1 without one:
    every node asks its parent's answer, over twice the distance in each pass."""
    n = len(parents)
    base = np.repeat(offsets[:-1], np.diff(offsets))
    up = np.where(parents >= 0, parents + base, n)
    stop = np.r_[marks.astype(bool), True]  # the place beyond the nodes stands for no parent
    ask = np.r_[up, n]
    while not stop[ask].all():
        ask = np.where(stop[ask], ask, ask[ask])
    ask = ask[:n]
    return np.where(ask < n, ask - base, -1)


def as_lists(values: np.ndarray, like: pa.Array, offsets: np.ndarray) -> pa.Array:
    mask = like.is_null() if like.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values), mask=mask)


def nearest_lists(parents: pa.Array, marks: pa.Array) -> pa.Array:
    up, offsets = flat(parents)
    return as_lists(nearest(up.astype(np.int64), flat(marks)[0].astype(bool), offsets).astype(np.int32), parents, offsets)


def selected(f: np.ndarray, parent: np.ndarray, end: np.ndarray, prev: np.ndarray, offsets: np.ndarray, program: list) -> np.ndarray:
    """Which nodes of whole pages a selector list matches. ``program``: for each selector its
    steps (combinator, bit); ``f``: the bits of the compounds that each node meets."""
    n = len(f)
    page = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    base = offsets[page]
    up, before = np.where(parent >= 0, parent + base, n), np.where(prev >= 0, prev + base, n)
    family = np.where(parent >= 0, up, n + page)  # nodes without a parent are their page's children
    out = np.zeros(n, bool)
    for steps in program:
        now = (f >> steps[0][1] & 1).astype(bool)
        for comb, bit in steps[1:]:
            if comb == " ":
                now = covered(end, now, offsets)
            elif comb == ">":
                now = np.r_[now, False][up]
            elif comb == "+":
                now = np.r_[now, False][before]
            else:  # an earlier child of the same parent
                first = np.full(n + len(offsets), n, np.int64)
                np.minimum.at(first, family[now], np.flatnonzero(now))
                now = np.arange(n) > first[family]
            now &= (f >> bit & 1).astype(bool)
        out |= now
    return out


def select_lists(flags: pa.Array, parents: pa.Array, ends: pa.Array, prevs: pa.Array, program: list) -> pa.Array:
    f, offsets = flat(flags)
    hit = selected(f, flat(parents)[0].astype(np.int64), flat(ends)[0], flat(prevs)[0].astype(np.int64), offsets, program)
    return as_lists(hit, flags, offsets)
