"""Helpers the operators share: shipping code, cutting lineage, Arrow slices."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtables.session import checkpoint_dir, ship_package

#: What the contracts call white space.
BLANKS = "[\\x20\\x09-\\x0D]"
#: Text bytes that one step of a Python task works on at a time.
SLICE_BYTES = 2 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers."""
    ship_package(spark)
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    import uuid

    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the column ``text`` of each part holds about ``most`` bytes
    (one row at least: a single very long text stays whole)."""
    for b in batches:
        col = b.column(b.schema.get_field_index(text))
        if col.offset or not len(col):
            col = pa.concat_arrays([col])
        big = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
        off = np.frombuffer(col.buffers()[1], np.int64 if big else np.int32)[: len(col) + 1] if len(col) else np.zeros(1, np.int64)
        at = 0
        while at < len(col):
            to = int(np.searchsorted(off, off[at] + most, side="right")) - 1
            to = min(max(to, at + 1), len(col))
            yield b.slice(at, to - at)
            at = to
    give_back()


def give_back() -> None:
    """Return what a Python worker has freed to the system: it lives on for other tasks,
    beside the executor's own memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column in one array and its rows' offsets (null: empty)."""
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    col = pa.concat_arrays([col]) if col.offset else col
    big = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64 if big else np.int32)[: len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def text_or_empty(col) -> F.Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def batch(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if not isinstance(cols[f.name], pa.Array) else cols[f.name] for f in schema], schema=schema)
