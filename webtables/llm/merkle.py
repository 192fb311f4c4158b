"""Merkle manifest of a dataset by time-forward processing (operator 11).

Nodes are labelled so that children come before their parents. A sweep in label order
hands each node's digest forward to its parent through a priority queue; a sweep in the
reversed order hands each node's proof suffix (the siblings of all levels above) back to
its children, down to the leaves.

The queue is external: leaves are cut into chunks of 16^3 consecutive nodes, and a chunk's
messages to and from the levels above travel as rows that Spark's shuffle sorts by label
(on disk where needed) into the stream of the chunk's nodes. Inside a chunk a heap holds
the few messages under way. The chunks' own roots are the nodes of the next round, so the
rounds grow with the logarithm of the largest source (three reach 6.9e10 leaves), and no
task holds more than a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions, ready

FAN = 16
#: Levels of a chunk, and its nodes.
HEIGHT = 3
CHUNK = FAN**HEIGHT
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- leaves ----------------------------------------------------------------


def field(c: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, ``:`` and the value."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def tampered(id_: Column) -> Column:
    """Whether the check tampers with a row: 5 divides the crc32 of its decimal id."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


# --- sweeps over one chunk -------------------------------------------------


def _label(level: int, index: int) -> int:
    """Ascends by the right end of what a node covers, then by level: a node comes after
    all that it covers, and few messages are under way at any time."""
    return ((index + 1) * FAN**level << 3) | level


def _place(label: int) -> tuple[int, int]:
    level = label & 7
    return level, (label >> 3) // FAN**level - 1


def height(n: int) -> int:
    """Levels above ``n`` nodes until one remains, or those of a chunk if there are more."""
    h = 0
    while n > 1 and h < HEIGHT:
        n, h = -(-n // FAN), h + 1
    return h


def forward(digests: list[bytes], top: int) -> list[list[bytes]]:
    """All levels of the chunk over ``digests`` up to level ``top``, a list each."""
    levels: list[list[bytes]] = [[] for _ in range(top + 1)]
    queue: list[tuple[int, int, bytes]] = []

    def emit(level: int, index: int, digest: bytes) -> None:
        levels[level].append(digest)
        if level < top:
            heappush(queue, (_label(level + 1, index // FAN), index, digest))

    def deliver(before: int | None) -> None:
        while queue and (before is None or queue[0][0] < before):
            label, got = queue[0][0], []
            while queue and queue[0][0] == label:
                got.append(heappop(queue)[2])
            emit(*_place(label), sha256(b"".join(got)).hexdigest().encode())

    for i, d in enumerate(digests):
        deliver(_label(0, i))
        emit(0, i, d)
    deliver(None)
    return levels


def backward(levels: list[list[bytes]], suffix: tuple | None) -> list[tuple | None]:
    """The proof suffix of each node of level 0. A suffix is (place among the siblings,
    the siblings' digests, the parent's suffix); ``suffix`` is that of the top node."""
    out: list[tuple | None] = [None] * len(levels[0])
    queue: list[tuple[int, tuple | None]] = [(-_label(len(levels) - 1, 0), suffix)]
    while queue:
        label, above = heappop(queue)
        level, index = _place(-label)
        if level == 0:
            out[index] = above
            continue
        run = levels[level - 1][index * FAN : (index + 1) * FAN]
        for j in range(len(run)):
            heappush(queue, (-_label(level - 1, index * FAN + j), (j, b"".join(run[:j] + run[j + 1 :]), above)))
    return out


def prove(digest: bytes, suffix: tuple | None) -> tuple[str, str]:
    """The digest of the proof, and the root that ``digest`` folds to along it."""
    proof = sha256()
    while suffix is not None:
        j, siblings, suffix = suffix
        proof.update(siblings)
        digest = sha256(siblings[: 64 * j] + digest + siblings[64 * j :]).hexdigest().encode()
    return proof.hexdigest(), digest.decode()


# --- rounds ----------------------------------------------------------------


def _chunks(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, int, list[tuple]]]:
    """(tree, chunk, rows) of a stream that is sorted by both."""
    now, rows = None, []
    for b in batches:
        cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in names]
        for key, row in zip(zip(*cols[:2], strict=True), zip(*cols[2:], strict=True), strict=True):
            if key != now:
                if rows:
                    yield *now, rows
                now, rows = key, []
            rows.append(row)
    if rows:
        yield *now, rows


def _climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    schema = pa.schema([("tree", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    for tree, chunk, rows in _chunks(batches, ["tree", "chunk", "n", "digest"]):
        n = rows[0][0]
        top = forward([d.encode() for _, d in rows], height(n))[-1]
        out.append((tree, chunk, -(-n // CHUNK), top[0].decode()))
        if len(out) >= 4096:
            yield flush()
            out.clear()
    if out:
        yield flush()


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of one chunk side by side in label order."""
    return rows.repartition(partitions(rows.sparkSession), "tree", "chunk").sortWithinPartitions("tree", "chunk", "pos")


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The forward sweep over trees given by their leaves (tree, pos, n, digest): the nodes
    that each round starts from, and (tree, digest) of the roots."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    rounds, done = [nodes], nodes.where("n = 1").select("tree", "digest")
    now = nodes
    while most > 1:
        now = cut(_dealt(now.where("n > 1").select("tree", (F.col("pos") / CHUNK).cast("long").alias("chunk"), "pos", "n", "digest")).select("tree", "chunk", "n", "digest").mapInArrow(_climb, "tree long, pos long, n long, digest string"))
        done = done.unionByName(now.where("n = 1").select("tree", "digest"))
        most = -(-most // CHUNK)
        if most > 1:
            rounds.append(now)
    return rounds, done


SUFFIX = "at array<int>, siblings array<string>"


def _told(message: tuple) -> tuple | None:
    """A suffix from its columns, lowest level first."""
    suffix = None
    for j, siblings in zip(reversed(message[0]), reversed(message[1]), strict=True):
        suffix = (j, siblings.encode(), suffix)
    return suffix


def _pass_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes of a round's nodes, from the message that comes before each chunk's nodes."""
    for tree, _, rows in _chunks(batches, ["tree", "chunk", "pos", "n", "digest", "own", "root", "sub", "at", "siblings"]):
        message, nodes = rows[0], rows[1:]
        levels = forward([r[2].encode() for r in nodes], height(nodes[0][1]))
        at, siblings = [], []
        for s in backward(levels, _told(message[6:])):
            js, ss = [], []
            while s is not None:
                js.append(s[0])
                ss.append(s[1].decode())
                s = s[2]
            at.append(js)
            siblings.append(ss)
        k = len(nodes)
        for i in range(0, k, 256):  # suffixes are long
            part = nodes[i : i + 256]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([tree] * len(part), pa.int64()), pa.array([r[0] for r in part], pa.int64()), pa.array([r[2] for r in part]), pa.array([r[3] for r in part], pa.int64()),
                    pa.array([message[4]] * len(part)), pa.array([message[5]] * len(part), pa.string()),
                    pa.array(at[i : i + 256], pa.list_(pa.int32())), pa.array(siblings[i : i + 256], pa.list_(pa.string())),
                ],
                names=["tree", "chunk", "digest", "own", "root", "sub", "at", "siblings"],
            )


def _prove_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, rows in _chunks(batches, ["tree", "chunk", "pos", "n", "digest", "own", "root", "sub", "at", "siblings", "bad"]):
        message, nodes = rows[0], rows[1:]
        levels = forward([r[2].encode() for r in nodes], height(nodes[0][1]))
        suffixes = backward(levels, _told(message[6:8]))
        proofs = [prove((r[8] or r[2]).encode(), s) for r, s in zip(nodes, suffixes, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[3] for r in nodes], pa.int64()), pa.array([r[2] for r in nodes]),
                pa.array([message[5]] * len(nodes)), pa.array([message[4]] * len(nodes)),
                pa.array([p for p, _ in proofs]), pa.array([f for _, f in proofs]), pa.array([f == message[4] for _, f in proofs]),
            ],
            names=["own", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
        )


def descend(rounds: list[DataFrame], tops: DataFrame, last=_pass_down, schema: str = f"tree long, chunk long, digest string, own long, root string, sub string, {SUFFIX}") -> DataFrame:
    """The reversed sweep. ``tops``: the message to each tree's top node (tree, n, root,
    sub, at, siblings). Gives what ``last`` makes of the lowest round's nodes and their
    suffixes."""
    down = None
    for k in range(len(rounds) - 1, -1, -1):
        enter = F.col("n") <= CHUNK ** (k + 1)
        if k:
            enter &= F.col("n") > CHUNK**k
        message = tops.where(enter).select("tree", F.lit(0).cast("long").alias("chunk"), "root", "sub", "at", "siblings")
        if down is not None:
            message = message.unionByName(down.select("tree", "chunk", "root", "sub", "at", "siblings"))
        nodes = rounds[k].withColumn("chunk", (F.col("pos") / CHUNK).cast("long"))
        if k:
            nodes = nodes.where("n > 1")
        both = nodes.unionByName(message.withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True)
        for name in ("own", "bad"):
            if name not in both.columns:
                both = both.withColumn(name, F.lit(None).cast("long" if name == "own" else "string"))
        cols = ["tree", "chunk", "pos", "n", "digest", "own", "root", "sub", "at", "siblings", "bad"]
        step = _dealt(both.select(*cols))
        if k:
            down = cut(step.mapInArrow(_pass_down, f"tree long, chunk long, digest string, own long, root string, sub string, {SUFFIX}"))
        else:
            return step.mapInArrow(last, schema)


def ranked(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their place among the rows of one ``key`` in the given order,
    ``n``, how many rows have it, and ``tree``, a number that ascends with the keys.

    Rows are range-partitioned by key and order, so a key that a third of all rows has is
    cut over many partitions; what a partition holds of a key is one row of a small table
    that gives each partition its first place."""
    spark = rows.sparkSession
    key = key.alias("_key")
    dealt = rows.select("*", key).repartitionByRange(partitions(spark), "_key", *order).sortWithinPartitions("_key", *order)
    rows = cut(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    held = rows.groupBy("_part", "_key").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_key")
    held = held.select(
        "_part", "_key", "_first",
        F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("n"),
        F.min("_first").over(whole).alias("tree"),
    )
    joined = rows.join(held, ["_part", "_key"])
    return joined.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_key", "_at", "_first", "_before")


def manifest(docs: DataFrame, id_col: str = "doc_id", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, leaf, subroot, root, proof_sha256, folded_root,
    verified.

    A leaf is the digest of the row's ``fields``. Leaves of one ``group_col`` (null is a
    group of its own, the first) ascend by id, null ids first; repeated ids by leaf. Runs
    of 16 nodes become one until one remains, the subroot; subroots in the groups' order
    give the root. The proof holds the siblings from the leaf to the root. ``folded_root``
    is folded from the leaf along its proof, for every fifth row (by crc32 of its id; never
    for a null id) from the leaf of the row with its text lower-cased; ``verified`` tells
    whether it is the root. Repeated rows are leaves of their own; empty and null texts
    differ. Other columns are not read. An empty table gives no rows."""
    ready(docs.sparkSession)
    hit = tampered(docs[id_col])
    changed = [F.translate(docs[c], UPPER, LOWER) if c == text_col else docs[c] for c in fields]
    leaves = cut(
        docs.select(
            docs[id_col].cast("long").alias("own"),
            docs[group_col].cast("string").alias("source"),
            leaf_digest(*[docs[c] for c in fields]).alias("digest"),
            F.when(hit, leaf_digest(*changed)).alias("bad"),
        )
    )
    nodes = cut(ranked(leaves, F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), ["own", "digest"]).drop("source"))
    rounds, subroots = climb(nodes)
    sizes = nodes.where("pos = 0").select("tree", F.col("n").alias("leaves"))
    subs = ranked(subroots.join(sizes, "tree").select(F.col("tree").alias("own"), "digest", "leaves"), F.lit(""), ["own"])
    subs = cut(subs)
    tops, root = climb(subs.select("tree", "pos", "n", "digest", "own"))
    message = root.join(subs.where("pos = 0").select("tree", "n"), "tree").select("tree", "n", F.col("digest").alias("root"), F.lit(None).cast("string").alias("sub"), F.array().cast("array<int>").alias("at"), F.array().cast("array<string>").alias("siblings"))
    told = descend(tops, message).select("own", "root", F.col("digest").alias("sub"), "at", "siblings")
    told = cut(told.join(subs.select("own", F.col("leaves").alias("n")), "own").withColumnRenamed("own", "tree"))
    schema = "own long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return descend(rounds, told, _prove_leaves, schema).withColumnRenamed("own", id_col)
