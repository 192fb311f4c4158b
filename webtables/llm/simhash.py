"""SimHash near duplicates by anchor-point covering (operator 13).

The anchors are the code words of a covering code: every 64-bit fingerprint lies within
the code's covering radius of one of them, its home. A fingerprint is replicated to every
anchor within covering radius plus threshold, so of two fingerprints within the threshold
each meets the other at the other's home, and fingerprints are compared per anchor only.

The code is a product over blocks of the fingerprint, and radius and threshold are kept
block by block: what lies beyond the radius of the single blocks must not exceed the
threshold in sum. This reaches the same pairs with far fewer replicas than one radius for
all bits. The blocks are binary Golay codes (23 bits, perfect, radius 3), all words of a
block (radius 0), or one word for a whole block (radius: its length, so it never tells
fingerprints apart). Anchors that are the home of too many fingerprints are compared under
the next, finer code, whose last step is all 64 bits: no group grows without bound, and no
pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, ready, slices
from .components import components
from .words import _BLANK, Words

BITS, SEED, SHINGLE, THRESHOLD = 64, 42, 3, 2
#: Shingles whose bits are counted at a time, and pairs compared at a time.
STEP, PAIRS = 1 << 16, 1 << 20
#: An anchor that is the home of more fingerprints goes on to the next code.
MOST_HOMES = 2048
#: Salts that spread the rows of one fingerprint or component.
SALTS = 64
#: Generator polynomial of the binary Golay code (fixed value):
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101


# --- fingerprints ----------------------------------------------------------


def _joined(words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words parted by one space each, and where each begins and ends."""
    size = words.end - words.start
    begin = np.cumsum(size + 1) - (size + 1)
    out = np.full(int((size + 1).sum()), 32, np.uint8)
    filled = np.ones(len(out), bool)
    filled[begin + size] = False
    out[filled] = words.hashed[~_BLANK[words.data]]
    return out.tobytes(), begin, begin + size


def text_fingerprints(col: pa.Array, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The SimHash of each text: a bit is 1 if it is set in over half the XXH64 of the
    text's shingles of ``size`` words, repeats included. Fewer words make one shingle;
    without words (or null) the fingerprint is zero."""
    words = Words(col, lower=True)
    data, begin, end = _joined(words)
    n = np.diff(words.first)
    each = np.where(n > 0, np.maximum(n - size + 1, 1), 0)  # shingles of each text
    doc = np.repeat(np.arange(len(n)), each)
    at = words.first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
    last = np.minimum(at + size, words.first[doc + 1]) - 1
    a, z = begin[at], end[last]
    counts = np.zeros((len(n), BITS), np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(at), STEP):
        bounds = zip(a[i : i + STEP].tolist(), z[i : i + STEP].tolist(), strict=True)
        h = np.fromiter((digest(data[s:e], seed) for s, e in bounds), "<u8", len(at[i : i + STEP]))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        d = doc[i : i + STEP]
        first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        counts[d[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return np.packbits(2 * counts > each[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp) of every row of ``docs``; ``fp`` is the fingerprint as a signed long."""
    ready(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fp = text_fingerprints(b.column(1), size, seed)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(work, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


# --- anchors ---------------------------------------------------------------


@dataclass(frozen=True)
class Block:
    """Bits ``at`` to ``at + bits - 1`` under one code: ``golay`` or ``all`` words.
    Bits that no block names are under the code of one word."""

    kind: str
    at: int
    bits: int


#: From coarse to fine. The first has 2^24 anchors, and a fingerprint is replicated to
#: about 61 of them at a threshold of two; the last compares whole fingerprints.
CODES = (
    (Block("golay", 0, 23), Block("golay", 23, 23)),
    (Block("golay", 0, 23), Block("golay", 23, 23), Block("all", 46, 18)),
    (Block("golay", 0, 23), Block("all", 23, 41)),
    (Block("all", 0, 64),),
)


def _weights(bits: int, weight: int) -> np.ndarray:
    """All words of ``bits`` bits with ``weight`` ones."""
    rows = list(combinations(range(bits), weight))
    return (np.uint64(1) << np.array(rows, np.uint64).reshape(len(rows), weight)).sum(1, dtype=np.uint64)


def syndromes(x: np.ndarray) -> np.ndarray:
    """The remainder of 23-bit words by the generator; zero for code words."""
    x = x.astype(np.int64)
    for k in range(22, 10, -1):
        x = np.where(x >> k & 1, x ^ (GOLAY << (k - 11)), x)
    return x


@lru_cache(maxsize=8)
def golay_errors(beyond: int) -> tuple[np.ndarray, np.ndarray]:
    """By syndrome, what to add to a word to reach the code words whose distance is
    ``beyond`` more than the radius 3 (``beyond`` 0: at most 3, which is one code word):
    the words, and where each syndrome's begin."""
    e = np.concatenate([_weights(23, w) for w in (range(4) if not beyond else [3 + beyond])])
    s = syndromes(e)
    order = np.argsort(s, kind="stable")
    return e[order], np.searchsorted(s[order], np.arange(2049))


@lru_cache(maxsize=16)
def all_errors(bits: int, beyond: int) -> np.ndarray:
    return _weights(bits, beyond)


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, .. (n[i] numbers) for each i."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def places(fp: np.ndarray, code: tuple[Block, ...], threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``fp``, anchor, home) for every anchor that a fingerprint is replicated to.
    ``home``: the one anchor within the covering radius of every block."""
    row, left, key = np.arange(len(fp)), np.full(len(fp), threshold), np.zeros(len(fp), np.uint64)
    for block in code:
        part = fp >> np.uint64(block.at) & np.uint64((1 << block.bits) - 1)
        syndrome = syndromes(part) if block.kind == "golay" else None
        width = np.uint64(12 if block.kind == "golay" else block.bits)
        rows, lefts, keys = [], [], []
        for beyond in range(threshold + 1):
            can = left >= beyond
            r, k = row[can], key[can]
            if block.kind == "golay":
                errors, first = golay_errors(beyond)
                s = syndrome[r]
                n = first[s + 1] - first[s]
                word = np.repeat(part[r], n) ^ errors[_spread(first[s], n)]
                word >>= np.uint64(11)  # the first 12 bits of a code word name it
            else:
                errors = all_errors(block.bits, beyond)
                n = np.full(len(r), len(errors))
                word = (part[r][:, None] ^ errors).ravel()
            rows.append(np.repeat(r, n))
            lefts.append(np.repeat(left[can] - beyond, n))
            shifted = np.repeat(k << width, n) if width < 64 else np.uint64(0)
            keys.append(shifted | word)
        row, left, key = (np.concatenate(v) for v in (rows, lefts, keys))
    return row, key, left == threshold


def _placed(fps: DataFrame, code: tuple[Block, ...], threshold: int, homes_only: bool = False) -> DataFrame:
    """(anchor, home, fp) of every replica; a fingerprint that no longer seeks its links
    has no home."""
    reach = 0 if homes_only else threshold

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                fp = b.column(0).slice(at, 2048).to_numpy(zero_copy_only=False)
                seek = b.column(1).slice(at, 2048).to_numpy(zero_copy_only=False)
                row, key, home = places(fp.view(np.uint64), code, reach)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(home & seek[row]), pa.array(fp[row])], names=["anchor", "home", "fp"])

    return fps.select("fp", "seek").mapInArrow(place, "anchor long, home boolean, fp long")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links (a, b) connect, one less than the nodes of each
    connected part."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def _meet(threshold: int):
    """Compare the rows of each anchor, sorted by anchor and homes first, with its homes.
    Only the homes of the anchor at hand are held from batch to batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, np.zeros(0, np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy(zero_copy_only=False)
            home = b.column(1).to_numpy(zero_copy_only=False)
            fp = b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            old = len(held) if held_key == key[0] else 0
            if old:
                key, home, fp = np.r_[np.full(old, held_key), key], np.r_[np.ones(old, bool), home], np.concatenate([held, fp])
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            homes = np.add.reduceat(home.astype(np.int64), first)
            group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(key)]))
            n = homes[group]
            n[:old] = 0  # the held homes have met each other before
            ends = np.cumsum(n)
            at = 0
            while at < len(n):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
                r = np.repeat(np.arange(at, to), n[at:to])
                h = _spread(first[group[at:to]], n[at:to])
                d = np.bitwise_count(fp[r] ^ fp[h])
                near = (d <= threshold) & (d > 0)
                if near.any():
                    x, y = forest(fp[r[near]], fp[h[near]])
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])
                at = to
            held_key, held = key[-1], fp[first[-1] : first[-1] + homes[-1]]

    return work


def links(fps: DataFrame, threshold: int = THRESHOLD, codes: tuple[tuple[Block, ...], ...] = CODES, most_homes: int = MOST_HOMES) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints of ``fps`` (column fp, no repeats) within
    ``threshold`` bits, enough to connect all that such pairs connect. Every pair is
    compared; of the links found in one step a task sends on a spanning forest."""
    spark = ready(fps.sparkSession)
    found, rows = None, fps.select("fp", F.lit(True).alias("seek"))
    for nth, code in enumerate(codes):
        placed, hot = _placed(rows, code, threshold), None
        if nth + 1 < len(codes):
            homes = _placed(rows.where("seek"), code, threshold, homes_only=True)
            hot = cut(homes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_homes).select("anchor"))
            hot = hot if hot.head(1) else None
        here = placed if hot is None else placed.join(hot, "anchor", "left_anti")
        met = here.repartition(partitions(spark), "anchor").sortWithinPartitions("anchor", F.desc("home")).mapInArrow(_meet(threshold), "a long, b long")
        found = met if found is None else found.unionByName(met)
        if hot is None:
            break
        # who has a home or a replica at a crowded anchor goes on; seeking, if it is the home
        rows = cut(placed.join(hot, "anchor", "left_semi").groupBy("fp").agg(F.max("home").alias("seek")))
    return found


# --- documents -------------------------------------------------------------


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: int = THRESHOLD, seed: int = SEED, most_homes: int = MOST_HOMES) -> DataFrame:
    """One row per row of ``docs``: id_col, fingerprint (16 lowercase hex digits),
    component_id (the smallest id reachable by links, its own included).

    Rows link when their fingerprints differ in ``threshold`` bits or fewer. A null text is
    empty; texts without words have fingerprint zero and link like any other. Repeated rows
    are rows of their own. Rows with a null id link too but name no component: theirs is
    null if no row with an id is reachable. Other columns are not read. An empty table
    gives no rows."""
    spark = ready(docs.sparkSession)
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")
    rows = cut(fingerprints(docs, id_col, text_col, size, seed).select("id", "fp", salt))
    # a fingerprint that many rows share is met in SALTS parts
    parts = rows.groupBy("fp", "salt").agg(F.min("id").alias("least"))
    classes = cut(parts.groupBy("fp").agg(F.min("least").alias("least")))
    member = cut(components(cut(links(classes, threshold, most_homes=most_homes))))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    named = member.select(F.col("node").alias("fp"), "component").join(classes, "fp")
    named = named.groupBy("component").agg(F.min("least").alias("component_id")).select("component", "component_id", salts)
    member = member.select(F.col("node").alias("fp"), "component", F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("salt"))
    member = member.join(named, ["component", "salt"]).select("fp", "component_id")
    classes = classes.join(member.withColumn("linked", F.lit(True)), "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    told = parts.select("fp", "salt").join(classes, "fp")
    return rows.join(told, ["fp", "salt"]).select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
