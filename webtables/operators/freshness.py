"""TTL-bounded dedup (which requests fetch, which are served) and
the freshness lookup of stored copies.

R2 semantics, per cache key in (ts, request_id) order: a request is
``served`` while a stored copy is valid (``fetched_at <= ts < fetched_at +
ttl``), else it is a ``fetch``; a successful fetch stores a new copy, a
failed one stores nothing, and serving never extends the TTL.

Plan. Only stores depend on the order: the next store is the first success at
or after the live copy's expiry. With time buckets one TTL wide, a bucket sees
one store at most and a copy lives into the next bucket at most, so once the
stores are known a row needs its own bucket's store and the one before: an
equi-join and an expression, with no sort of the log. The stores come from the
successes alone (key, time, id):

* a key of few successes is walked in one go. Of the others, a success whose
  previous success is a TTL or more before it always stores; such places cut
  the key into independent runs, and a run of many rows is cut further, at
  bucket bounds, into segments of bounded size;
* what a segment does to the copy that is live at its entry is a step function
  (expiry at entry -> last store), made for all segments side by side; a scan
  over the few steps of a run composes them to the expiry at each entry;
* with its entry known each segment walks its own stores, again side by side.

So one key with steady traffic uses as many tasks as it has segments. A task
holds the times of one segment at most; a bucket that alone is over the bound
is streamed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webtables.functions.urls import ttl_for_url

# Bucket widths of the freshness join: 1 s to 2**30 s; the next number stands for "never expires".
WIDTHS = 31
# Successes of a run after which a new segment begins, and steps sent as one row.
SEGMENT_ROWS, STEPS = 200_000, 50_000


def _numbers(col: pa.Array) -> np.ndarray:
    return col.to_numpy(zero_copy_only=False)


def _group_starts(batch: pa.RecordBatch, names: tuple[str, ...], last: tuple | None) -> tuple[np.ndarray, tuple]:
    """Where a new group of the columns ``names`` begins in a sorted batch (row 0 only if
    it differs from ``last``, the group the batch before ended with), and its last group."""
    n = batch.num_rows
    change = np.zeros(n, bool)
    for name in names:
        col = batch.column(name)
        change[1:] |= pc.not_equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    group = lambda i: tuple(batch.column(c)[i].as_py() for c in names)
    change[0] = last is None or group(0) != last
    return np.flatnonzero(change), group(n - 1)


def step_function(ts: np.ndarray, ttl: int, until: int) -> tuple[np.ndarray, np.ndarray]:
    """What a segment with successes at ``ts`` (ascending) does to the copy that is live at
    its entry, for expiries before ``until``: (bounds, stores), where an expiry ``e`` leads
    to the last store ``stores[j]`` with ``j`` the first bound at or after ``e``; beyond the
    last bound nothing is stored."""
    n = len(ts)
    after = np.searchsorted(ts, ts + ttl, side="left")
    cur = np.arange(min(n, int(np.searchsorted(ts, until, side="left")) + 1))
    first = ts[: len(cur)]
    while True:
        ahead = after[cur]
        more = ahead < n
        if not more.any():
            break
        cur = np.where(more, ahead, cur)
    end = np.r_[cur[1:] != cur[:-1], True] if len(cur) else np.zeros(0, bool)
    return first[end], ts[cur[end]]


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step functions of segments; rows sorted by (cache_key, run, seg, ts_us). ``alone``
    marks a segment of one bucket, whose steps are its times and need not be held."""
    schema = pa.schema([("cache_key", pa.string()), ("run", pa.int64()), ("seg", pa.int64()), ("nth", pa.int32()), ("ttl_us", pa.int64()), ("bounds", pa.list_(pa.int64())), ("stores", pa.list_(pa.int64()))])

    def rows(group, nth, ttl, bounds, stores):
        for i in range(0, len(bounds), STEPS):
            cols = [[group[0]], [group[1]], [group[2]], [nth + i // STEPS], [ttl], [bounds[i : i + STEPS]], [stores[i : i + STEPS]]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    last, held, about, nth = None, [], None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ts, ttl, bucket = (_numbers(batch.column(c)) for c in ("ts_us", "ttl_us", "_b"))
        alone = _numbers(batch.column("alone")).astype(bool)
        starts, now = _group_starts(batch, ("cache_key", "run", "seg"), last)
        cuts = starts[starts > 0].tolist()
        for a, b in zip([0, *cuts], [*cuts, n], strict=True):
            if a or len(starts) > len(cuts):
                if held:
                    yield from rows(about[0], 0, about[1], *step_function(np.concatenate(held), about[1], about[2]))
                group = tuple(batch.column(c)[a].as_py() for c in ("cache_key", "run", "seg"))
                about, held, nth = (group, int(ttl[a]), int(bucket[a] + 1) * int(ttl[a])), [], 0
            if alone[a]:
                yield from rows(about[0], nth, about[1], ts[a:b], ts[a:b])
                nth += -(-(b - a) // STEPS)
            else:
                held.append(ts[a:b])
        last = now
    if held:
        yield from rows(about[0], 0, about[1], *step_function(np.concatenate(held), about[1], about[2]))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compose the step functions of each run, sorted by (cache_key, run, seg, nth): the
    expiry of the copy that is live when a segment begins."""
    run, seg, expiry, done = None, None, None, False
    for batch in batches:
        out: list[tuple] = []
        for i in range(batch.num_rows):
            r, s = (batch.column("cache_key")[i].as_py(), batch.column("run")[i].as_py()), batch.column("seg")[i].as_py()
            if r != run:
                run, seg, expiry = r, None, None
            if s != seg:
                seg, done = s, False
                if expiry is not None:
                    out.append((r[0], s, expiry))
            if done:
                continue
            bounds, ttl = batch.column("bounds")[i].values, batch.column("ttl_us")[i].as_py()
            j = 0 if expiry is None else int(np.searchsorted(_numbers(bounds), expiry, side="left"))
            if j < len(bounds):
                expiry, done = batch.column("stores")[i].values[j].as_py() + ttl, True
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["cache_key", "seg", "entry_us"])


def walk(ts: np.ndarray, ttl: np.ndarray, starts: np.ndarray, expiry: np.ndarray) -> np.ndarray:
    """Rows of ``ts`` that store a copy. Groups begin at ``starts`` with the live copy's
    expiry ``expiry[i]``; within a group times ascend."""
    stores = []
    times, lives = ts.tolist(), ttl.tolist()
    for a, b, e in zip(starts.tolist(), [*starts[1:].tolist(), len(ts)], expiry.tolist(), strict=True):
        i = a
        while i < b:
            if times[i] < e:
                i += int(np.searchsorted(ts[i:b], e, side="left"))
                if i == b:
                    break
            stores.append(i)
            e = times[i] + lives[i]
            i += 1
    return np.array(stores, np.int64)


def _stores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The successes that store a copy; rows sorted by (cache_key, seg, ts_us, id). A row
    with ``entry_us`` comes first in its segment and tells the live copy's expiry."""
    none = np.iinfo(np.int64).min
    last, expiry = None, none
    for batch in batches:
        if not batch.num_rows:
            continue
        new, now = _group_starts(batch, ("cache_key", "seg"), last)
        told = batch.column("entry_us").is_valid().to_numpy(zero_copy_only=False)
        ts, ttl = _numbers(batch.column("ts_us")), _numbers(batch.column("ttl_us"))
        entry = _numbers(batch.column("entry_us").fill_null(none))
        starts = np.unique(np.r_[0, new])
        e = np.full(len(starts), none)
        if 0 not in new:
            e[0] = expiry
        e = np.where(told[starts], entry[starts], e)
        begins = starts + told[starts]  # the successes of a group begin after what it is told
        ends = np.r_[starts[1:], len(ts)]
        some = begins < ends
        rows = np.flatnonzero(~told)
        at = np.searchsorted(rows, begins[some])
        found = rows[walk(ts[rows], ttl[rows], at, e[some])] if len(rows) else rows
        tail = found[found >= starts[-1]]
        expiry, last = (int(ts[tail[-1]] + ttl[tail[-1]]) if len(tail) else int(e[-1])), now
        kept = batch.take(pa.array(found))
        yield pa.RecordBatch.from_arrays([kept.column(c) for c in ("cache_key", "_b", "ts_us", "id")], names=["cache_key", "_b", "ts_us", "id"])


def stored_copies(successes: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The successes (cache_key, ttl_us, _b, s: struct of ts_us and id) that store a copy
    under the fold, as (cache_key, _b, ts_us, id); of equal times the least id.

    A key of fewer than ``segment_rows`` successes is walked as one segment. For the others
    (few, so their table is small) one row per bucket tells run and segment; it is joined to
    the successes, which are dealt by (key, segment) once. What a segment has to know of the
    one before travels as a row among its own."""
    key = "cache_key"
    id_type = successes.schema["s"].dataType["id"].dataType
    ts = F.col("s.ts_us")
    buckets = successes.groupBy(key, "_b").agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.first("ttl_us").alias("_ttl"), F.count(F.lit(1)).alias("_n"))
    by_key = Window.partitionBy(key).orderBy("_b")
    upto = by_key.rowsBetween(Window.unboundedPreceding, 0)
    buckets = buckets.withColumn("_all", F.sum("_n").over(Window.partitionBy(key))).where(F.col("_all") > segment_rows)
    before = F.lag("_last").over(by_key)
    # the first success of a bucket starts a run when no copy can be alive; what a run
    # holds decides where it is cut
    runs = buckets.withColumn("_new", (before.isNull() | (F.col("_first") >= before + F.col("_ttl"))).cast("long"))
    runs = runs.withColumn("run", F.sum("_new").over(upto)).withColumn("_sum", F.sum("_n").over(upto))
    part = F.floor((F.col("_sum") - F.col("_n")) / segment_rows)
    big = F.col("_n") >= segment_rows  # such a bucket is a segment of its own
    fresh = F.coalesce(big | F.lag(big).over(by_key) | (part != F.lag(part).over(by_key)), F.lit(True))
    runs = runs.withColumn("_cut", (fresh | (F.col("_new") == 1)).cast("long")).withColumn("seg", F.sum("_cut").over(upto))
    runs = runs.select(key, "_b", "run", "seg", big.alias("alone"))
    rows = successes.join(runs, [key, "_b"])
    steps = (
        rows.select(key, "run", "seg", ts.alias("ts_us"), "ttl_us", "_b", "alone")
        .repartition(key, "run", "seg").sortWithinPartitions(key, "run", "seg", "ts_us")
        .mapInArrow(_steps, "cache_key string, run long, seg long, nth int, ttl_us long, bounds array<long>, stores array<long>")
    )
    entries = steps.repartition(key, "run").sortWithinPartitions(key, "run", "seg", "nth").mapInArrow(_entries, "cache_key string, seg long, entry_us long")
    told = entries.select(
        key, "seg", F.lit(None).cast("long").alias("_b"), F.lit(None).cast("long").alias("ts_us"), F.lit(0).cast("long").alias("ttl_us"),
        F.lit(None).cast(id_type).alias("id"), "entry_us",
    )
    walked = successes.join(runs.select(key, "_b", "seg"), [key, "_b"], "left").select(
        key, F.coalesce("seg", F.lit(0)).alias("seg"), "_b", ts.alias("ts_us"), "ttl_us", F.col("s.id").alias("id"), F.lit(None).cast("long").alias("entry_us")
    )
    dealt = walked.unionByName(told).repartition(key, "seg").sortWithinPartitions(key, "seg", F.asc_nulls_first("ts_us"), "id")
    return dealt.mapInArrow(_stores, f"cache_key string, _b long, ts_us long, id {id_type.simpleString()}")


def label_fetches(log: DataFrame, ttl_override: int | None = None, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """R2: ``log`` + ``label`` (fetch/served), ``fetched_at`` (the copy a
    row read or wrote), ``ttl_s``. ``log`` needs ``request_id, ts, url,
    success, cache_key``. See the module's notes for the plan."""
    ttl_s = F.lit(ttl_override) if ttl_override is not None else ttl_for_url(F.col("url"))
    base = (
        log.withColumn("ttl_s", ttl_s.cast("int"))
        .withColumn("_ts", F.unix_micros(F.col("ts").cast("timestamp")))
        .withColumn("_ttl", F.greatest(F.col("ttl_s").cast("long"), F.lit(1)) * 1_000_000)
        .withColumn("_b", F.floor(F.col("_ts") / F.col("_ttl")).cast("long"))
    )
    successes = base.where("success").select("cache_key", F.col("_ttl").alias("ttl_us"), "_b", F.struct(F.col("_ts").alias("ts_us"), F.col("request_id").alias("id")).alias("s"))
    stores = stored_copies(successes, segment_rows)
    # a store counts in its own bucket and in the next one
    kind = stores.schema["id"].dataType
    here = F.struct(F.col("_b").alias("_b"), F.col("ts_us").alias("_own"), F.col("id").alias("_id"), F.lit(None).cast("long").alias("_old"))
    then = F.struct((F.col("_b") + 1).alias("_b"), F.lit(None).cast("long").alias("_own"), F.lit(None).cast(kind).alias("_id"), F.col("ts_us").alias("_old"))
    known = stores.select("cache_key", F.inline(F.array(here, then)))
    known = known.groupBy("cache_key", "_b").agg(F.max("_own").alias("_own"), F.max("_id").alias("_id"), F.max("_old").alias("_old"))
    # a row is served by the copy of the bucket before, or by its own bucket's if that was
    # stored before it
    by_old = F.coalesce(F.col("_ts") < F.col("_old") + F.col("_ttl"), F.lit(False))
    since = F.coalesce((F.col("_ts") > F.col("_own")) | ((F.col("_ts") == F.col("_own")) & (F.col("request_id") >= F.col("_id"))), F.lit(False))
    stored = since & (F.col("_ts") == F.col("_own")) & (F.col("request_id") == F.col("_id"))
    copy = F.when(by_old, F.col("_old")).when(since, F.col("_own"))
    return base.join(known, ["cache_key", "_b"], "left").select(
        *log.columns, "ttl_s",
        F.when(by_old | (since & ~stored), F.lit("served")).otherwise(F.lit("fetch")).alias("label"),
        F.timestamp_micros(copy).cast(log.schema["ts"].dataType).alias("fetched_at"),
    )


def hit_counts(labelled: DataFrame) -> DataFrame:
    """Store hits and misses from the labelled log (feeds A7)."""
    return labelled.agg(
        F.coalesce(F.sum((F.col("label") == "served").cast("long")), F.lit(0)).alias("hits"),
        F.coalesce(F.sum((F.col("label") == "fetch").cast("long")), F.lit(0)).alias("misses"),
    )


def fresh_copy(requests: DataFrame, store: DataFrame, content: bool = False, ttls: list[int | None] | None = None) -> DataFrame:
    """For each request, the stored copy valid at its time
    (``fetched_at <= ts < fetched_at + ttl_s``; a null ``ttl_s`` never
    expires), newest if several; ``content`` attaches the copy's content.

    Range join made linear by time buckets: a copy of TTL ``t`` is put in
    buckets of the power of two at or above ``t`` seconds, so it touches two
    of them at most, and a request looks into one bucket of each width that
    the store has (at most ``WIDTHS`` of them). The joins carry keys and
    times only; content is looked up once per answered request. ``ttls`` names
    the values that ``ttl_s`` takes, which saves a pass over the store; a copy
    with another one is an error. Requests with a column ``ttl_s`` of their own (the
    TTL that their key's copies have) look into one bucket only."""
    second = 1_000_000
    f_us = F.unix_micros(F.col("fetched_at").cast("timestamp"))
    ttl = F.col("ttl_s").cast("long")
    level = F.when(ttl.isNull(), F.lit(WIDTHS)).otherwise(F.least(F.ceil(F.log2(F.greatest(ttl, F.lit(1)))).cast("int"), F.lit(WIDTHS - 1)))
    copies = store.select("cache_key", "fetched_at", f_us.alias("f_us"), (f_us + ttl * second).alias("e_us"), level.alias("level"))
    copies = copies.where("e_us IS NULL OR e_us > f_us")
    width = (F.pow(F.lit(2.0), F.col("level")) * second).cast("long")
    first, last = F.floor(F.col("f_us") / width), F.floor((F.col("e_us") - 1) / width)
    copies = copies.withColumn("bucket", F.explode(F.when(F.col("e_us").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(first.cast("long"), last.cast("long")))))
    own = "ttl_s" in requests.columns
    if own:
        found = []
    elif ttls is None:
        found = [r["level"] for r in store.select(level.alias("level")).distinct().collect()]  # at most WIDTHS + 1 numbers
    else:
        found = [WIDTHS if t is None else min((max(t, 1) - 1).bit_length(), WIDTHS - 1) for t in ttls]
        wrong = F.raise_error(F.concat(F.lit("fresh_copy: ttls does not name the TTL of key "), F.col("cache_key")))
        copies = copies.withColumn("level", F.when(F.col("level").isin(*found), F.col("level")).otherwise(wrong.cast("int")))
    held = level if own else F.explode(F.lit(sorted(set(found)) or [0]).cast("array<int>"))
    ts_us = F.unix_micros(F.col("ts").cast("timestamp"))
    req = requests.select("request_id", "cache_key", ts_us.alias("ts_us"), held.alias("level"))
    req = req.withColumn("bucket", F.when(F.col("level") == WIDTHS, F.lit(0).cast("long")).otherwise(F.floor(F.col("ts_us") / width).cast("long")))
    live = req.join(copies, ["cache_key", "level", "bucket"]).where("f_us <= ts_us AND (e_us IS NULL OR ts_us < e_us)")
    best = live.groupBy("request_id").agg(F.max("fetched_at").alias("fetched_at"))
    out = requests.join(best, "request_id", "left")
    if content:
        one = store.groupBy("cache_key", "fetched_at").agg(F.max("content").alias("content"))
        out = out.join(one, ["cache_key", "fetched_at"], "left")
    return out
