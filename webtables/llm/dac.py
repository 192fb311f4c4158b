"""Token ids on disk as directly addressable codes (operator 8).

An id is split into chunks of ``chunk`` bits. Level 0 holds the lowest chunk of every
id; a bit per entry says whether the id goes on in the next level, and a directory of
counts of those bits gives each entry's place there. So any token is found with one
read per level and no block is decoded. A file holds the documents of one range of
ids in ascending order; documents are found by binary search over its id table.

File: ``DAC1``, a header of 64-bit little-endian numbers (documents, tokens, levels,
chunk bits, then for each level its entries), the documents' ids and ends, and for
each level the chunks, the continuation bitmap (low bit first) and the directory
(ones before each ``BLOCK`` bits, 64-bit).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, partitions, ready, shared_path, slices
from .wordcache import TEXT_BYTES, read_tokenizer, word_ids

MAGIC = b"DAC1"
CHUNK = 8
#: Stands for a null id in a file's id table.
NO_ID = -(1 << 63)
#: Bits between two entries of a rank directory.
BLOCK = 512


def encode_levels(ids: np.ndarray, chunk: int = CHUNK) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, directory) of each level; the last level's bitmap is all zero."""
    kind = np.uint8 if chunk <= 8 else np.uint16
    levels, rest = [], ids.astype(np.uint64)
    while True:
        low = (rest & np.uint64((1 << chunk) - 1)).astype(kind)
        rest = rest >> np.uint64(chunk)
        more = rest > 0
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        levels.append((low, np.packbits(more, bitorder="little"), np.r_[0, np.cumsum(ones)[:-1]].astype("<i8") if len(ones) else ones))
        if not more.any():
            return levels
        rest = rest[more]


def decode_levels(levels: list[tuple[np.ndarray, np.ndarray]], chunk: int) -> np.ndarray:
    """All ids of (chunks, bitmap) levels, for a whole file or for a slice of one."""
    out = None
    for low, bits in reversed(levels):
        ids = low.astype(np.uint64)
        if out is not None and len(out):
            more = np.unpackbits(bits, count=len(low), bitorder="little").astype(bool)
            ids[more] |= out << np.uint64(chunk)
        out = ids
    return out


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The store that ``path`` (a folder's URI, or a local path) names, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), path[len("file:") :].replace("//", "/", 1) if path.startswith("file://") else path[len("file:") :]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def file_bytes(doc_ids: np.ndarray, ends: np.ndarray, levels: list, chunk: int = CHUNK) -> Iterator[bytes]:
    """The file's parts in order."""
    tokens = int(ends[-1]) if len(ends) else 0
    yield MAGIC + np.array([len(doc_ids), tokens, len(levels), chunk, *[len(x[0]) for x in levels]], "<u8").tobytes()
    yield doc_ids.astype("<i8").tobytes()
    yield ends.astype("<i8").tobytes()
    for low, bits, ones in levels:
        yield low.astype("<u1" if chunk <= 8 else "<u2").tobytes()
        yield bits.tobytes()
        yield ones.astype("<i8").tobytes()


class TokenFile:
    """Random access to one file: only the header is read on opening."""

    def __init__(self, path: str):
        store, at = file_system(path)
        self.file = store.open_input_file(at)
        if self.file.read_at(4, 0) != MAGIC:
            raise ValueError(f"not a token file: {path}")
        self.documents, self.tokens, n, self.chunk = self._ints(4, 4)
        entries = self._ints(n, 36)
        self.ids_at = 36 + 8 * n
        at = self.ids_at + 16 * self.documents
        self.levels = []
        width = 1 if self.chunk <= 8 else 2
        for size in entries:
            bits, ones = at + size * width, at + size * width + -(-size // 8)
            self.levels.append((size, at, bits, ones))
            at = ones + 8 * -(-size // BLOCK)
        self.kind = np.dtype("<u1" if width == 1 else "<u2")

    def _ints(self, n: int, at: int) -> list[int]:
        return np.frombuffer(self.file.read_at(8 * n, at), "<i8").tolist()

    def _rank(self, level: int, i: int) -> int:
        """Ones before bit i of a level: a directory entry and the bits after it."""
        size, _, bits, ones = self.levels[level]
        block = i // BLOCK
        if block * BLOCK >= size:
            block = max(0, -(-size // BLOCK) - 1)
        before = self._ints(1, ones + 8 * block)[0] if size else 0
        data = np.frombuffer(self.file.read_at(-(-(i - block * BLOCK) // 8), bits + block * BLOCK // 8), np.uint8)
        return before + int(np.unpackbits(data, count=i - block * BLOCK, bitorder="little").sum())

    def token(self, i: int) -> int:
        """The i-th token of the file."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        out, shift = 0, 0
        for level, (_, chunks, bits, _) in enumerate(self.levels):
            out |= int(np.frombuffer(self.file.read_at(self.kind.itemsize, chunks + i * self.kind.itemsize), self.kind)[0]) << shift
            if not self.file.read_at(1, bits + i // 8)[0] >> (i % 8) & 1:
                break
            i, shift = self._rank(level, i), shift + self.chunk
        return out

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Tokens start to stop - 1, reading those entries only."""
        got, a, b = [], start, stop
        for level, (size, chunks, bits, _) in enumerate(self.levels):
            low = np.frombuffer(self.file.read_at((b - a) * self.kind.itemsize, chunks + a * self.kind.itemsize), self.kind)
            raw = np.frombuffer(self.file.read_at(-(-b // 8) - a // 8, bits + a // 8), np.uint8) if b > a else np.zeros(0, np.uint8)
            more = np.unpackbits(raw, count=a % 8 + b - a, bitorder="little")[a % 8 :]
            got.append((low, np.packbits(more, bitorder="little")))
            if not more.any():
                break
            a = self._rank(level, a)
            b = a + int(more.sum())
        return decode_levels(got, self.chunk)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """The documents' ids and the token each one ends before."""
        both = np.frombuffer(self.file.read_at(16 * self.documents, self.ids_at), "<i8")
        return both[: self.documents], both[self.documents :]


def write_tokens(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, chunk: int = CHUNK) -> DataFrame:
    """Write the ids of ``docs`` in ascending order of ``id_col`` to files under ``path``
    (a folder that driver and executors share) and return their list: part, path,
    documents, tokens, start (tokens in the files before).

    Each file is written under a name of its attempt and then renamed, so a task that
    runs twice leaves one whole file. A null text is empty. Rows with a null id come
    last; repeated ids are stored side by side. Other columns are not read. An empty
    table gives an empty list."""
    spark = ready(docs.sparkSession)
    content = spark.sparkContext.broadcast(read_tokenizer(tokenizer))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = word_ids(content.value), TaskContext.get()
        ids, lengths, tokens = [], [], []
        for b in slices(batches, "text", TEXT_BYTES):
            ids.append(b.column(0).fill_null(NO_ID).to_numpy())
            data, at = encoder.encode_column(b.column(1))
            if end_id is not None:
                data = np.insert(data, at[1:], end_id)
            lengths.append(np.diff(at) + (end_id is not None))
            tokens.append(data.astype(np.uint16 if encoder.library.get_vocab_size() <= 1 << 16 else np.uint32))
        if not ids:
            return
        ends = np.cumsum(np.concatenate(lengths))
        store, folder = file_system(path)
        store.create_dir(folder, recursive=True)
        part = task.partitionId()
        name = f"part-{part:06d}.dac"
        own = f"{folder}/_{name}.{task.taskAttemptId()}"
        with store.open_output_stream(own) as f:
            for block in file_bytes(np.concatenate(ids), ends, encode_levels(np.concatenate(tokens), chunk), chunk):
                f.write(block)
        store.move(own, f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{path}/{name}"]), pa.array([len(ends)], pa.int64()), pa.array([int(ends[-1])], pa.int64())], names=["part", "path", "documents", "tokens"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"), F.xxhash64(docs[text_col]).alias("h"))
    order = [F.asc_nulls_last("id"), F.col("h")]
    ordered = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "text").select("id", "text")
    files = cut(ordered.mapInArrow(write, "part int, path string, documents long, tokens long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_tokens(spark: SparkSession, files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read files of :func:`write_tokens` back, one row per document: id_col, start
    (tokens before it in all files), n_tokens, ids (little-endian unsigned 32-bit)."""
    ready(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = TokenFile(path)
                ids, ends = f.table()
                starts = np.r_[0, ends[:-1]]
                at = 0
                while at < len(ids):  # a few million tokens at a time, whole documents
                    to = max(at + 1, int(np.searchsorted(ends, starts[at] + (1 << 20), side="right")))
                    data = f.slice(int(starts[at]), int(ends[to - 1])).astype("<u4").tobytes()
                    a, z = (starts[at:to] - starts[at]) * 4, (ends[at:to] - starts[at]) * 4
                    parts = [data[i:j] for i, j in zip(a.tolist(), z.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at:to], mask=ids[at:to] == NO_ID), pa.array(start + starts[at:to]), pa.array(ends[at:to] - starts[at:to]), pa.array(parts, pa.binary())], names=["id", "start", "n_tokens", "ids"])
                    at = to

    return files.select("path", "start", "part").repartition(partitions(spark), "part").select("path", "start").mapInArrow(read, "id long, start long, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def read_digests(spark: SparkSession, files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the files hold per document: id_col, start, n_tokens, ids_crc32."""
    return read_tokens(spark, files, id_col).select(id_col, "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def token_store(docs: DataFrame, tokenizer: str, **named) -> DataFrame:
    """Write ``docs`` to a new folder under the shared checkpoint folder; its file list."""
    return write_tokens(docs, tokenizer, shared_path(docs.sparkSession, "tokens"), **named)
