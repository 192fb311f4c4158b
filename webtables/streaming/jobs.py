"""Structured Streaming jobs.

Sources are file streams over a directory (one table's files and folders picked by
a glob path); results go to parquet sinks or ``foreachBatch``
overwrites under the shared checkpoint folder, never to the driver-memory
sink. ``run_available`` drives a query with ``trigger(availableNow=True)``
so a test or a scheduled job processes everything present and stops. With the
same ``work`` folder a later run resumes: only new files are read.

* T1 running counters per request type (complete state, rewritten per batch)
* T2 windowed request stats with a watermark (late rows dropped)
* T3 TTL-bounded dedup per cache key with ``transformWithStateInPandas``, keys in groups:
  rows wait in list state for the watermark and leave in time order by event-time timers
* T4 last-N requests: bounded heaps in keyed state
* T5 page conversion (parse -> text, links) as a stateless append stream
"""

from __future__ import annotations

import heapq
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from webtables.functions.urls import ttl_for_url
from webtables.operators.requests import counters
from webtables.session import checkpoint_dir, configure
from webtables.sources.derived import request_log_from_events


def _work_dir(spark: SparkSession, name: str, work: str | None) -> str:
    """The folder of a job's state and result: the caller's, with which a later run goes
    on where the last one ended, or a new one in the shared checkpoint folder."""
    return work or os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:12]}")


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A file stream of one table: ``name.parquet``, a file or a folder of part files, and
    what arrives later as ``name-*.parquet`` or in the folder (schema taken from the first)."""
    configure(spark)
    root = sf_dir.rstrip("/")
    schema = spark.read.parquet(f"{root}/{name}.parquet").schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(f"{root}/{name}*.parquet")


def request_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """The request log as a stream; ``ts`` becomes TIMESTAMP (UTC session)
    because watermarks refuse TIMESTAMP_NTZ."""
    log = request_log_from_events(table_stream(spark, sf_dir, "events", max_files))
    return log.withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(writer) -> None:
    """Run until all input that is there has been processed; errors are raised."""
    writer.trigger(availableNow=True).start().awaitTermination()


@contextmanager
def _rocksdb(spark: SparkSession):
    """State in RocksDB while a query of arbitrary state runs, which needs it."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(provider, before)


def _overwrite_sink(path: str):
    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return write


def running_counters(spark: SparkSession, sf_dir: str, work: str | None = None) -> DataFrame:
    """Counters per request type over the whole stream."""
    work = _work_dir(spark, "t1", work)
    agg = counters(request_stream(spark, sf_dir), ["request_type"])
    run_available(
        agg.writeStream.outputMode("complete")
        .option("checkpointLocation", os.path.join(work, "ckpt"))
        .foreachBatch(_overwrite_sink(os.path.join(work, "out")))
    )
    return spark.read.parquet(os.path.join(work, "out"))


def windowed_stats(spark: SparkSession, sf_dir: str, size: str = "1 day", slide: str | None = None,
                   watermark: str = "1 day", mode: str = "complete", work: str | None = None) -> DataFrame:
    """Request stats per event-time window (tumbling, or sliding when
    ``slide`` is set). ``append`` emits closed windows only."""
    work = _work_dir(spark, "t2", work)
    s = request_stream(spark, sf_dir).withWatermark("ts", watermark)
    win = F.window("ts", size, slide) if slide else F.window("ts", size)
    agg = s.groupBy(win.alias("w")).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.col("success").cast("long")).alias("successful"),
        F.sum((~F.col("success")).cast("long")).alias("failed"),
        F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))).cast("long").alias("total_retries"),
    ).select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"),
        "total", "successful", "failed", "total_retries",
    )
    ck = os.path.join(work, "ckpt")
    out = os.path.join(work, "out")
    if mode == "append":
        run_available(agg.writeStream.outputMode("append").format("parquet")
                      .option("checkpointLocation", ck).option("path", out))
    else:
        run_available(agg.writeStream.outputMode("complete").option("checkpointLocation", ck)
                      .foreachBatch(_overwrite_sink(out)))
    return spark.read.parquet(out)


_T3_OUT = "request_id long, cache_key string, label string, fetched_at_us long"
# past any request, and within what pandas can hold
_FAR = "2261-01-01 00:00:00"


def fold_times(ts: np.ndarray, ok: np.ndarray, ttl: np.ndarray, live: tuple[int, int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int] | None]:
    """R2 over one key's rows in order, from the live copy (stored, expiry): which rows are
    served, the copy each one read or wrote, whether there is one, and the copy left."""
    served, fetched, has = np.zeros(len(ts), bool), np.zeros(len(ts), np.int64), np.zeros(len(ts), bool)
    good, i = np.flatnonzero(ok), 0
    while i < len(ts):
        if live is not None and ts[i] < live[1]:
            j = i + int(np.searchsorted(ts[i:], live[1], side="left"))
            served[i:j], fetched[i:j], has[i:j], i = True, live[0], True, j
            continue
        k = int(np.searchsorted(good, i))
        if k == len(good):
            break
        i = int(good[k])
        live = (int(ts[i]), int(ts[i]) + int(ttl[i]))
        fetched[i], has[i], i = ts[i], True, i + 1
    return served, fetched, has, live


#: Groups of cache keys that share a state; stays the same as long as a work folder is used.
KEY_GROUPS = 4096
_T3_ROWS = pa.schema([("cache_key", pa.dictionary(pa.int32(), pa.string())), ("request_id", pa.int64()), ("success", pa.bool_()), ("ts_us", pa.int64()), ("ttl_us", pa.int64())])


def _packed(rows: pa.Table) -> bytes:
    """Rows as one value of the state: an Arrow stream, each key once."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows.unify_dictionaries().combine_chunks())
    return sink.getvalue().to_pybytes()


def _unpacked(values: Iterator[tuple]) -> pa.Table:
    parts = [pa.ipc.open_stream(v[0]).read_all() for v in values]
    return pa.concat_tables([pa.Table.from_batches([], _T3_ROWS), *parts]).unify_dictionaries().combine_chunks()


class TtlDedup(StatefulProcessor):
    """T3 for one group of keys: a state of its own for each key costs more calls than its
    few rows. Rows wait in list state, a value for each part that came, until the watermark
    has passed them, so that no earlier one can still come, and leave in time order through
    the fold of their key. One event-time timer stands at the first waiting row or the first
    expiry of a live copy, when it ends."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.live = handle.getListState("live", "cache_key string, stored_us long, expiry_us long")

    def _wake(self, at_us: int) -> None:
        """Set the group's one timer, unless it stands earlier."""
        at, set_for = -(-at_us // 1000), list(self.handle.listTimers())
        if not set_for or at < min(set_for):
            for t in set_for:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, parts = [], []
        for pdf in rows:
            pdf = pdf[pdf["request_id"].notna()]  # the end marker is no request
            if len(pdf):
                pdf = pdf[["cache_key", "request_id", "success", "ts_us", "ttl_us"]].assign(success=[bool(x) for x in pdf["success"]])
                plain = pa.schema([(f.name, pa.string() if f.name == "cache_key" else f.type) for f in _T3_ROWS])
                part = pa.Table.from_pandas(pdf, plain, preserve_index=False)
                parts.append((_packed(part.set_column(0, _T3_ROWS.field(0), part["cache_key"].dictionary_encode())),))
                first.append(int(pdf["ts_us"].min()))
        if first:
            self.waiting.appendList(parts)
            self._wake(min(first))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = _unpacked(self.waiting.get() if self.waiting.exists() else iter([]))
        live = {r[0]: (r[1], r[2]) for r in self.live.get()} if self.live.exists() else {}
        ts = rows["ts_us"].to_numpy()
        if (ts <= passed).any():
            out, live = self._fold(rows.filter(pa.array(ts <= passed)), live)
            yield out
            rows = rows.filter(pa.array(ts > passed))
            if len(rows):
                self.waiting.put([(_packed(rows),)])
            else:
                self.waiting.clear()
        live = {k: c for k, c in live.items() if c[1] > passed}
        if live:
            self.live.put([(k, *c) for k, c in live.items()])
        else:
            self.live.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        ends = [c[1] for c in live.values()] + [int(t) for t in rows["ts_us"].to_numpy()]
        if ends:
            self._wake(min(ends))

    @staticmethod
    def _fold(rows: pa.Table, live: dict) -> tuple[pd.DataFrame, dict]:
        """The labels of rows that the watermark has passed, key by key, and the copies
        left."""
        codes = rows["cache_key"].combine_chunks()
        names, code = codes.dictionary, codes.indices.fill_null(-1).to_numpy()
        ids, ts = rows["request_id"].to_numpy(), rows["ts_us"].to_numpy()
        order = np.lexsort((ids, ts, code))
        code, ids, ts = code[order], ids[order], ts[order]
        ok, ttl = rows["success"].to_numpy()[order], rows["ttl_us"].to_numpy()[order]
        served, fetched, has = np.zeros(len(ts), bool), np.zeros(len(ts), np.int64), np.zeros(len(ts), bool)
        cuts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(ts)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            k = names[int(code[a])].as_py() if code[a] >= 0 else None
            served[a:b], fetched[a:b], has[a:b], left = fold_times(ts[a:b], ok[a:b], ttl[a:b], live.get(k))
            if left is not None:
                live[k] = left
        return pd.DataFrame({
            "request_id": ids,
            "cache_key": rows["cache_key"].cast(pa.string()).to_numpy()[order],
            "label": np.where(served, "served", "fetch"),
            "fetched_at_us": pd.Series(pd.array(fetched, dtype="Int64")).mask(~has),
        }), live

    def close(self) -> None:
        pass


def ttl_dedup_stream(spark: SparkSession, sf_dir: str, watermark: str = "1 day", work: str | None = None,
                     max_files: int | None = None, close: bool | None = None) -> DataFrame:
    """Label each request ``fetch`` or ``served`` per cache key, as R2 does, over a
    stream whose rows come up to ``watermark`` out of order (later ones are dropped, as
    Spark does). A row's label comes out when the watermark has passed it. State: the rows
    that still wait and one live copy a key, kept for KEY_GROUPS groups of keys; both end
    by timer.

    ``close`` ends the stream: a marker far in the future lets the last rows go, and what
    comes later is late. Without it (the default with a ``work`` folder) they wait in the
    state for the next run."""
    close = work is None if close is None else close
    work = _work_dir(spark, "t3", work)
    s = request_stream(spark, sf_dir, max_files).select(
        "request_id", "cache_key", "success",
        F.unix_micros("ts").alias("ts_us"),
        (ttl_for_url(F.col("url")).cast("long") * 1_000_000).alias("ttl_us"),
        "ts",
    )
    ends = os.path.join(work, "end")
    none = spark.createDataFrame([], s.schema)
    none.write.mode("append").parquet(ends)
    both = s.unionByName(spark.readStream.schema(s.schema).parquet(ends)).withWatermark("ts", watermark)
    keyed = both.withColumn("key_group", F.pmod(F.xxhash64("cache_key"), F.lit(KEY_GROUPS)).cast("int"))
    out = keyed.groupBy("key_group").transformWithStateInPandas(
        TtlDedup(), outputStructType=_T3_OUT, outputMode="append", timeMode="eventTime"
    )

    def go() -> None:
        run_available(
            out.writeStream.outputMode("append").format("parquet")
            .option("checkpointLocation", os.path.join(work, "ckpt")).option("path", os.path.join(work, "out"))
        )

    with _rocksdb(spark):
        go()
        if close:
            mark = spark.range(1).select(
                F.lit(None).cast("long").alias("request_id"), F.lit("").alias("cache_key"), F.lit(False).alias("success"),
                F.lit(0).cast("long").alias("ts_us"), F.lit(0).cast("long").alias("ttl_us"), F.lit(_FAR).cast("timestamp").alias("ts"),
            )
            mark.select(*s.columns).write.mode("append").parquet(ends)
            go()
    res = spark.read.schema(_T3_OUT).parquet(os.path.join(work, "out"))
    return res.withColumn("fetched_at", F.timestamp_micros("fetched_at_us").cast("timestamp_ntz")).drop("fetched_at_us")


#: Keys that share the newest rows, so that one key's heap is not met by every row.
HEAPS = 8
_T4_ROW = "ts_us long, request_id long, url string, success boolean"


class NewestRows(StatefulProcessor):
    """T4 for one heap: its newest ``n`` rows, kept in list state and sent on when they
    change. What is held is bounded by ``n`` however many rows come."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("newest", _T4_ROW)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        kept = list(held)
        for pdf in rows:
            new = pdf.nlargest(self.n, ["ts_us", "request_id"])  # at most n of a batch matter
            new = zip(*(new[c].tolist() for c in ("ts_us", "request_id", "url", "success")), strict=True)
            kept = heapq.nlargest(self.n, [*kept, *new], key=lambda r: (r[0], r[1]))
        if kept != held:
            self.rows.put(kept)
            out = pd.DataFrame(kept, columns=["ts_us", "request_id", "url", "success"])
            yield out.assign(heap=key[0])

    def close(self) -> None:
        pass


def last_n_stream(spark: SparkSession, sf_dir: str, n: int = 100, work: str | None = None, max_files: int | None = None) -> DataFrame:
    """T4: the newest ``n`` requests (by time, then id) kept across micro-batches. Rows are
    dealt over HEAPS keys; each keeps a heap of its newest ``n`` in state, and a batch
    rewrites the partitions of the heaps that it changed. The state belongs to the batch,
    so a batch that runs again writes the same. The answer is the newest ``n`` of the heaps'
    few rows."""
    work = _work_dir(spark, "t4", work)
    out = os.path.join(work, "out")
    s = request_stream(spark, sf_dir, max_files).where("ts IS NOT NULL AND request_id IS NOT NULL")
    rows = s.select(F.pmod(F.xxhash64("request_id"), F.lit(HEAPS)).cast("int").alias("heap"), F.unix_micros("ts").alias("ts_us"), "request_id", "url", "success")
    newest = rows.groupBy("heap").transformWithStateInPandas(
        NewestRows(n), outputStructType=_T4_ROW + ", heap int", outputMode="update", timeMode="none"
    )

    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("heap").parquet(out)

    with _rocksdb(spark):
        run_available(newest.writeStream.outputMode("update").option("checkpointLocation", os.path.join(work, "ckpt")).foreachBatch(write))
    top = spark.read.schema(_T4_ROW).parquet(out).orderBy(F.desc("ts_us"), F.desc("request_id")).limit(n)
    return top.select("request_id", F.timestamp_micros("ts_us").alias("ts"), "url", "success")


def page_conversion_stream(spark: SparkSession, sf_dir: str, work: str | None = None) -> DataFrame:
    """T5: new page files -> text and link counts, stateless append."""
    from webtables.operators.content import page_links, page_text
    from webtables.operators.parse import parse_pages

    work = _work_dir(spark, "t5", work)
    pages = table_stream(spark, sf_dir, "pages").select("page_id", "url", "html")
    conv = parse_pages(pages, keep_html=False).select(
        "page_id", page_text("nodes").alias("text"), F.size(page_links("nodes", "url")).alias("links")
    )
    run_available(
        conv.writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", os.path.join(work, "ckpt")).option("path", os.path.join(work, "out"))
    )
    return spark.read.parquet(os.path.join(work, "out"))
