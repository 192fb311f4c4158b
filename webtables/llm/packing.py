"""Best-fit packing by exact-complement hashing (operator 5).

A packing plan depends on nothing but how many pieces there are of each length, and
there are at most ``capacity`` lengths. So the driver plans on that histogram, whose
size is fixed, and Spark does the rest: tokenizing, counting, numbering the pieces of
each length, and looking each number up in the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ready, slices
from .wordcache import TEXT_BYTES, read_tokenizer, word_ids

CAPACITY = 2048
END_ID = 0


def complements(counts: np.ndarray, longest: int, gap: int, pairs: np.ndarray) -> tuple[int, ...] | None:
    """One, two or three available lengths, none over ``longest``, that sum to ``gap``.

    Larger parts are taken first, which leaves the small, flexible lengths for later.
    ``pairs[s]`` is False once no two available lengths sum to s; lengths only ever
    run out, so it never has to be set again."""

    def pair(s: int, most: int) -> tuple[int, int] | None:
        if s < 2 or not pairs[s]:
            return None
        low = np.arange(1, s // 2 + 1)
        ok = (counts[low] > 0) & (counts[s - low] > 0) & ((low * 2 != s) | (counts[low] > 1))
        if not ok.any():
            pairs[s] = False
            return None
        ok &= s - low <= most
        return (s - int(low[ok][0]), int(low[ok][0])) if ok.any() else None

    if gap <= longest and counts[gap]:
        return (gap,)
    if two := pair(gap, longest):
        return two
    for a in (np.flatnonzero(counts[: min(longest, gap - 2) + 1])[::-1]).tolist() if gap > 2 else ():
        if a * 3 < gap:
            break
        counts[a] -= 1
        # with one a taken, a failed search must not mark the sum as dead for good
        kept = pairs[gap - a]
        two = pair(gap - a, a)
        if counts[a] < 2:
            pairs[gap - a] = kept
        counts[a] += 1
        if two:
            return (a, *two)
    return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one sequence, number of such sequences) for pieces of these lengths.

    From the longest length down, combinations that fill a sequence exactly are used
    up as often as their lengths are available; what is left goes to the open sequence
    with the least room that still holds it (best fit). Every step exhausts a length
    or a group of open sequences, so the plan has a few rows per length at most."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    pairs = np.ones(capacity + 1, bool)
    steps: list[tuple[tuple[int, ...], int]] = []
    left: dict[int, int] = {}
    for length in range(capacity, 0, -1):
        while counts[length]:
            counts[length] -= 1
            rest = () if length == capacity else complements(counts, length, capacity - length, pairs)
            counts[length] += 1
            if rest is None:
                left[length] = int(counts[length])
                counts[length] = 0
                break
            pattern = (length, *rest)
            uses = {x: pattern.count(x) for x in pattern}
            k = min(int(counts[x]) // m for x, m in uses.items())
            for x, m in uses.items():
                counts[x] -= k * m
            steps.append((pattern, k))
    rooms: dict[int, list[list]] = {}  # room left -> groups of [lengths, number]
    for length, n in left.items():  # from the longest down
        while n:
            room = min((g for g in rooms if g >= length), default=None)
            if room is None:
                rooms.setdefault(capacity - length, []).append([(length,), n])
                break
            pattern, k = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
            used = min(k, n)
            if k > used:
                rooms.setdefault(room, []).append([pattern, k - used])
            rooms.setdefault(room - length, []).append([(*pattern, length), used])
            n -= used
    return steps + [(tuple(p), k) for groups in rooms.values() for p, k in groups]


def plan_table(steps: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan by length: pieces numbered ``first`` and on of ``length`` go to the
    sequences ``sequence`` and on, at ``offset``."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, k in steps:
        offset = 0
        for length in pattern:
            rows.append((length, used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + k
            offset += length
        sequence += k
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4).T
    return dict(zip(("length", "first", "sequence", "offset"), cols, strict=True))


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int | None = END_ID, with_ids: bool = False) -> DataFrame:
    """Each document's ids (and ``end_id`` after them) in pieces of ``capacity`` tokens;
    the last may be shorter. id_col, piece, start, length, ids_crc32, and with
    ``with_ids`` the ids as little-endian unsigned 32-bit bytes."""
    spark = ready(docs.sparkSession)
    content = spark.sparkContext.broadcast(read_tokenizer(tokenizer))
    id_type = docs.schema[id_col].dataType.simpleString()
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(content.value)
        for b in slices(batches, "text", TEXT_BYTES):
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            flat, ends = encoder.encode_column(b.column(1))
            every, ends = flat.astype("<u4").tobytes(), (4 * ends).tolist()
            for row, (z, e) in enumerate(zip(ends, ends[1:], strict=False)):
                data = every[z:e] + tail
                for n, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append(row)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            cols = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    schema = f"id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return texts.mapInArrow(tokenize, schema).withColumnRenamed("id", id_col)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any columns, with ``length`` from 1 to ``capacity``) and their
    sequence_id and offset. Pieces are rows: repeated rows are placed one by one.

    Pieces of one length are numbered without bringing them together: each partition
    numbers its own, after those of the partitions before it."""
    spark = ready(pieces.sparkSession)
    held = cut(pieces)
    names = held.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            length = b.column(b.schema.get_field_index("length")).to_numpy()
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            first = np.r_[0, np.flatnonzero(np.diff(ranked)) + 1]
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.repeat(first, np.diff(np.r_[first, len(length)])) + seen[ranked]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(length), part, np.int64)), pa.array(rank)], names=[*names, "__part", "__rank"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields)
    numbered = held.mapInArrow(number, f"{fields}, __part long, __rank long")
    # a row for each length and partition
    by_part = numbered.groupBy("length", "__part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = by_part.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "__part", "__before")
    # at most ``capacity`` rows come to the driver
    lengths = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = spark.sparkContext.broadcast(plan_table(plan(lengths, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = table.value
        key = p["length"] << 48 | p["first"]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "__rank"))
            at = np.searchsorted(key, length << 48 | rank, side="right") - 1
            cols = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(p["sequence"][at] + rank - p["first"][at]), pa.array(p["offset"][at])], names=[*names, "sequence_id", "offset"])

    ranked = numbered.join(by_part, ["length", "__part"]).withColumn("__rank", F.col("__rank") + F.col("__before")).select(*names, "__rank")
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int | None = END_ID) -> DataFrame:
    """Pack every document: one row per piece (id_col, piece, start, length, ids_crc32,
    sequence_id, offset). A null text is empty; with an ``end_id`` every document has
    a token, without one an empty document has no piece. Only documents of more than
    ``capacity`` tokens are cut. Repeated rows and null ids are packed like any other;
    other columns are not read. An empty table gives no rows."""
    return pack(token_pieces(docs, tokenizer, id_col, text_col, capacity, end_id), capacity)


def sequences(docs: DataFrame, tokenizer: str, **named) -> DataFrame:
    """The packed sequences themselves: sequence_id, length, ids (little-endian unsigned
    32-bit). A sequence holds ``capacity`` tokens at most, so it is one row."""
    placed = pack(token_pieces(docs, tokenizer, with_ids=True, **named), named.get("capacity", CAPACITY))
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
