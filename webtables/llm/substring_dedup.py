"""Substring dedup: Rabin-Karp hashes of every word window, counted in Spark (operator 7).

Documents are dealt to slices by ranges of their id, so that slice order is id order.
A task hashes every window of its slice and sends each distinct hash once, packed by
hash range; so a passage that a third of all documents hold is one entry a slice. A
reducer finds the hashes that occur in several slices and tells every slice but the
first. A slice then knows all windows that start in an earlier document, its own or
another slice's, and merges them into maximal intervals of words to remove.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, ready
from .words import Words

WINDOW = 50
#: Slices and hash ranges for each shuffle partition.
SPREAD = 2
#: Text bytes of a slice that are hashed at a time.
STEP = 2 << 20


def pack_hashes(h: np.ndarray) -> bytes:
    """Sorted 64-bit hashes as differences, byte plane by byte plane: the upper planes
    are almost all zero and vanish when Spark compresses the shuffle."""
    return np.diff(h, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_hashes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _steps(texts: pa.ChunkedArray) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) in steps of about STEP bytes, whole texts."""
    at = 0
    for col in texts.chunks:
        size = np.cumsum(np.nan_to_num(np.asarray(pa.compute.binary_length(col).to_numpy(zero_copy_only=False), float))) if len(col) else np.zeros(0)
        i = 0
        while i < len(col):
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + STEP, side="right")))
            yield at + i, col.slice(i, j - i)
            i = j
        at += len(col)


def _ids(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    none = col.is_null().to_numpy().astype(bool)
    return col.fill_null(0).to_numpy(), none


def _earliest(group: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct window hashes of a slice and the least id of a document with each."""
    ids, none = _ids(group["id"])
    found, least = [], []
    for at, texts in _steps(group["text"]):
        words = Words(texts)
        h, inside = words.windows(window)
        of = words.doc() + at
        inside &= ~none[of]  # a document without an id is before none
        h, of = h[inside], ids[of[inside]]
        order = np.lexsort((of, h))
        h, of = h[order], of[order]
        new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        found.append(h[new])
        least.append(of[new])
    h, of = (np.concatenate(found), np.concatenate(least)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if len(found) > 1:
        order = np.lexsort((of, h))
        h, of = h[order], of[order]
        new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        h, of = h[new], of[new]
    return h, of


def _cover(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """True for the words that a window at one of ``starts`` covers."""
    edge = np.zeros(n + window + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:n]) > 0


def split_ids(docs: DataFrame, id_col: str, n: int) -> list[int]:
    """Up to n - 1 ids that part the documents into about equal ranges."""
    if n < 2:
        return []
    found = docs.select(F.percentile_approx(F.col(id_col), [k / n for k in range(1, n)], 100 * n).alias("q")).first()["q"]
    return sorted(set(found or []))


def _dealt(docs: DataFrame, id_col: str, text_col: str, n_slices: int) -> DataFrame:
    spark = ready(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    splits = spark.sparkContext.broadcast(np.array(split_ids(rows, "id", n_slices), np.int64))  # one id a slice

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).fill_null(0).to_numpy()
            at = np.searchsorted(splits.value, ids, side="right")
            none = b.column(0).is_null().to_numpy(zero_copy_only=False)
            at[none] = np.arange(int(none.sum())) % (len(splits.value) + 1)  # in no order with others: any slice
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *b.columns], names=["slice", "id", "text"])

    return rows.mapInArrow(deal, "slice int, id long, text string")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, cut_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: id_col, n_words, n_removed, intervals (array of
    struct(start, stop) of word numbers), kept_sha256; with ``cut_text`` also
    ``kept_text``, the kept words joined by one space, where words go, and the whole
    text's ``text_sha256``.

    Words are ``[^\\x20\\x09-\\x0D]+``. A window of ``window`` words goes if the same
    words also start in a document with a smaller id; windows are judged on the input.
    Texts that are null, empty or shorter than a window lose nothing. A row with a null
    id is before and after no other: it loses nothing and takes nothing away. Rows that
    share an id are one document as far as order goes, so they take nothing from each
    other. Other columns are not read. An empty table gives no rows.

    Equal windows are told by a 64-bit hash of 64-bit word hashes."""
    spark = ready(docs.sparkSession)
    n = SPREAD * partitions(spark)
    width = (1 << 64) // n + 1
    dealt = _dealt(docs, id_col, text_col, n)

    def send(group: pa.Table) -> pa.Table:
        h, _ = _earliest(group, window)
        at = np.searchsorted(h, np.array([k * width for k in range(n)], np.uint64))
        at = np.r_[at, len(h)]
        full = np.flatnonzero(np.diff(at))
        data = [pack_hashes(h[at[k] : at[k + 1]]) for k in full.tolist()]
        which = group["slice"][0].as_py() if len(group) else 0
        return pa.table([pa.array(np.full(len(full), which, np.int32)), pa.array(full.astype(np.int32)), pa.array(data, pa.binary())], names=["slice", "bucket", "hashes"])

    def meet(group: pa.Table) -> pa.Table:
        of = group["slice"].to_numpy()
        parts = [unpack_hashes(x.as_buffer()) for x in group["hashes"]]
        h = np.concatenate(parts)
        s = np.repeat(of, [len(p) for p in parts])
        del parts
        order = np.lexsort((s, h))
        h, s = h[order], s[order]
        later = np.r_[False, h[1:] == h[:-1]]  # an earlier slice has it too
        h, s = h[later], s[later]
        order = np.argsort(s, kind="stable")  # stays sorted by hash in a slice
        h, s = h[order], s[order]
        to, first = np.unique(s, return_index=True)
        data = [pack_hashes(x) for x in np.split(h, first[1:])] if len(to) else []
        return pa.table([pa.array(to.astype(np.int32)), pa.array(data, pa.binary())], names=["slice", "hashes"])

    def take_out(group: pa.Table, told: pa.Table) -> pa.Table:
        earlier = np.sort(np.concatenate([np.zeros(0, np.uint64), *[unpack_hashes(x.as_buffer()) for x in told["hashes"]]]))
        known, least = _earliest(group, window)
        ids, none = _ids(group["id"])
        out: dict[str, list] = {"n_words": [], "n_removed": [], "starts": [], "stops": [], "sha": [], "kept": [], "whole": []}
        for at, texts in _steps(group["text"]):
            words = Words(texts)
            h, inside = words.windows(window)
            of = words.doc() + at
            inside &= ~none[of]
            w = np.flatnonzero(inside)
            x = h[w]
            seen = _among(earlier, x)
            if len(known):
                seen |= least[np.minimum(np.searchsorted(known, x), len(known) - 1)] < ids[of[w]]
            gone = _cover(w[seen], len(h), window)
            data, bounds = words.data.tobytes(), words.bounds.tolist()
            for d in range(len(texts)):
                a, z = int(words.first[d]), int(words.first[d + 1])
                g = gone[a:z]
                removed = int(g.sum())
                edge = np.flatnonzero(np.diff(np.r_[False, g, False].astype(np.int8)))
                if not removed:
                    kept = b" ".join(data[words.start[a] : words.end[z - 1]].split()) if z > a else b""
                else:
                    keep = a + np.flatnonzero(~g)
                    kept = b" ".join([data[i:j] for i, j in zip(words.start[keep].tolist(), words.end[keep].tolist(), strict=True)])
                out["n_words"].append(z - a)
                out["n_removed"].append(removed)
                out["starts"].append(edge[::2])
                out["stops"].append(edge[1::2])
                out["sha"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept.decode() if cut_text and removed else None)
                out["whole"].append(hashlib.sha256(data[bounds[d] : bounds[d + 1]]).hexdigest() if cut_text and removed else None)
        sizes = np.cumsum([0] + [len(x) for x in out["starts"]]).astype(np.int32)
        flat = lambda k: pa.array(np.concatenate([np.zeros(0, np.int64), *out[k]]).astype(np.int64))
        spans = pa.ListArray.from_arrays(pa.array(sizes), pa.StructArray.from_arrays([flat("starts"), flat("stops")], ["start", "stop"]))
        cols = [group["id"], pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), spans, pa.array(out["sha"], pa.string()), pa.array(out["kept"], pa.string()), pa.array(out["whole"], pa.string())]
        return pa.table(cols, names=["id", "n_words", "n_removed", "intervals", "kept_sha256", "kept_text", "text_sha256"])

    sent = dealt.groupBy("slice").applyInArrow(send, "slice int, bucket int, hashes binary")
    told = sent.groupBy("bucket").applyInArrow(meet, "slice int, hashes binary")
    schema = "id long, n_words long, n_removed long, intervals array<struct<start:long,stop:long>>, kept_sha256 string, kept_text string, text_sha256 string"
    done = dealt.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(take_out, schema)
    return done.withColumnRenamed("id", id_col) if cut_text else done.drop("kept_text", "text_sha256").withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, window: int = WINDOW) -> DataFrame:
    """``docs`` without the words that :func:`removals` finds: a text that loses words
    becomes its kept words joined by one space (and ``length_col`` their code points);
    all other rows and columns stay as they are.

    Rows that share an id are matched by their text's SHA-256 too."""
    changed = removals(docs, id_col, text_col, window, cut_text=True).where("n_removed > 0")
    changed = changed.select(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha"), "kept_text").distinct()
    row = F.struct(*[docs[c] for c in docs.columns])
    rows = docs.select(row.alias("row"), docs[id_col].cast("long").alias("id"), F.sha2(docs[text_col].cast("string"), 256).alias("sha"))
    both = rows.join(changed, ["id", "sha"], "left")
    new = {text_col: F.coalesce("kept_text", F.col("row")[text_col])}
    if length_col:
        counted = F.length("kept_text").cast(docs.schema[length_col].dataType)
        new[length_col] = F.when(F.col("kept_text").isNull(), F.col("row")[length_col]).otherwise(counted)
    return both.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def _among(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x
