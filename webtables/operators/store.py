"""Page store as a table (S3-S7, S10) and its statistics.

The store is a parquet directory of ``(cache_key, url, content, fetched_at,
ttl_s)`` rows; "now" is always a parameter so results repeat. Latest-per-key
uses ``max_by`` (an aggregate with map-side partial combine, so a hot key
is reduced before the shuffle) instead of a window over the key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webtables.session import checkpoint_dir

# Store size limit, warning threshold (bytes).
SIZE_LIMIT = 1024 * 1024 * 1024
WARNING_THRESHOLD = 900 * 1024 * 1024


def _now(now) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


def is_live(now) -> Column:
    """Valid while ``now < fetched_at + ttl_s``; null ``ttl_s`` never expires."""
    f = F.col("fetched_at").cast("timestamp")
    return F.col("ttl_s").isNull() | (
        F.unix_micros(_now(now)) < F.unix_micros(f) + F.col("ttl_s").cast("long") * 1_000_000
    )


def store_write(store: DataFrame, new_rows: DataFrame) -> DataFrame:
    """S3: last write per key wins (by ``fetched_at``; on a tie the new row, and of
    several new rows the one whose content sorts last). The newest rows are chosen by times
    alone, and that choice holds before their contents are read or joined; contents move
    once, those of the newest, where a digest settles what is left of a tie."""
    cols = store.columns
    order = lambda new: F.struct("fetched_at", F.lit(new).alias("_new"))
    times = store.select("cache_key", order(0).alias("_o")).unionByName(new_rows.select("cache_key", order(1).alias("_o")))
    kind = times.schema["_o"].dataType  # of both sides' times
    best = times.groupBy(F.col("cache_key").alias("_key")).agg(F.max("_o").alias("_best"))
    # each side for itself: Spark moves the choice below a side's own joins, not below a union
    side = lambda df, new: df.select(*cols).join(best, (F.col("cache_key") == F.col("_key")) & (order(new).cast(kind) == F.col("_best")), "left_semi")
    newest = side(store, 0).unionByName(side(new_rows, 1))
    won = newest.groupBy("cache_key").agg(F.max_by(F.struct(*cols), F.sha2(F.coalesce(F.col("content"), F.lit("")), 256)).alias("_row"))
    return won.select("_row.*")


def store_get(store: DataFrame, keys: DataFrame, now, default: str | None = None) -> DataFrame:
    """Value by key; expired entries are invisible; ``default`` when
    absent. ``keys`` has a ``cache_key`` column; its rows are kept."""
    live = store.where(is_live(now)).select("cache_key", "content")
    return keys.join(live, "cache_key", "left").withColumn(
        "content", F.coalesce(F.col("content"), F.lit(default))
    )


def store_delete(store: DataFrame, keys: DataFrame, now=None) -> tuple[DataFrame, DataFrame]:
    """(store without the keys, per key whether it existed)."""
    k = keys.select("cache_key").distinct()
    remaining = store.join(k, "cache_key", "left_anti")
    present = store if now is None else store.where(is_live(now))
    existed = k.join(present.select("cache_key").distinct().withColumn("existed", F.lit(True)), "cache_key", "left").select(
        "cache_key", F.coalesce(F.col("existed"), F.lit(False)).alias("existed")
    )
    return remaining, existed


def store_clear(store: DataFrame) -> DataFrame:
    """An empty store with the same schema."""
    return store.limit(0)


def store_expire(store: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(live entries, one-row count of removed entries)."""
    live = store.where(is_live(now))
    removed = store.agg(F.coalesce(F.sum((~is_live(now)).cast("long")), F.lit(0)).alias("removed"))
    return live, removed


def save_store(store: DataFrame, path: str) -> None:
    """The parquet directory is the store; a new session reads it back."""
    store.write.mode("overwrite").parquet(path)


def load_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def store_stats(store: DataFrame, hits: DataFrame | None = None, size_limit: int = SIZE_LIMIT) -> DataFrame:
    """entry_count, size_bytes (content bytes), size_mb,
    size_limit_bytes, size_limit_mb, utilization_percent, hits, misses,
    hit_rate (4 places), size_warning."""
    s = store.agg(
        F.count(F.lit(1)).alias("entry_count"),
        F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("long").alias("size_bytes"),
    )
    if hits is None:
        return stats_from_totals(s, size_limit)
    from webtables.operators.rows import side_by_side

    return stats_from_totals(side_by_side(s, hits), size_limit)


def stats_from_totals(totals: DataFrame, size_limit: int = SIZE_LIMIT) -> DataFrame:
    """A7/A8 columns from a one-row frame of ``entry_count, size_bytes`` and,
    when present, ``hits, misses``."""
    s = totals
    has_hits = "hits" in s.columns
    s = s.select(
        *(["hits", "misses"] if has_hits else []),
        "entry_count",
        "size_bytes",
        F.round(F.col("size_bytes") / (1024 * 1024), 2).alias("size_mb"),
        F.lit(size_limit).cast("long").alias("size_limit_bytes"),
        F.round(F.lit(size_limit / (1024 * 1024)), 2).alias("size_limit_mb"),
        F.round(F.col("size_bytes") / F.lit(size_limit) * 100, 2).alias("utilization_percent"),
        (F.col("size_bytes") >= F.lit(WARNING_THRESHOLD * size_limit // SIZE_LIMIT)).alias("size_warning"),
    )
    if not has_hits:
        return s
    return s.withColumn(
        "hit_rate",
        F.when(F.col("hits") + F.col("misses") > 0, F.round(F.col("hits") / (F.col("hits") + F.col("misses")), 4))
        .otherwise(F.lit(0.0)),
    )


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running byte totals of one partition, in its order."""
    part, total = TaskContext.get().partitionId(), 0
    for b in batches:
        sums = total + np.cumsum(b.column("_bytes").to_numpy(zero_copy_only=False))
        if len(sums):
            total = int(sums[-1])
        yield pa.RecordBatch.from_arrays(
            [b.column("_at"), b.column("cache_key"), pa.array(sums, pa.int64()), pa.array(np.full(b.num_rows, part, np.int32))],
            names=["_at", "cache_key", "_sum", "_part"],
        )


def retain_within_budget(store: DataFrame, budget_bytes: int, order_col: str = "fetched_at",
                         bucket: str = "HOUR") -> DataFrame:
    """Keep the newest entries whose running byte total stays within the budget
    (on equal times the greater key first; entries equal in both stay or go together;
    entries without a time come last, null content counts as empty).

    What is kept is the beginning of one order, so only its end is looked for, with times,
    keys and sizes alone: bytes per time bucket name the one bucket that straddles the
    budget; its entries are range-partitioned by the order, each partition adds up its own,
    and the totals of the partitions before (a row each) are added. A bucket that holds
    everything is spread over all tasks. The store itself is filtered by that end, without
    a join or a shuffle."""
    at = F.coalesce(F.col(order_col).cast("timestamp"), F.lit("0001-01-01").cast("timestamp"))
    size = F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")
    sized = store.select(at.alias("_at"), F.coalesce("cache_key", F.lit("")).alias("cache_key"), size.alias("_bytes"))
    checkpoint_dir(store.sparkSession)
    sized = sized.checkpoint().withColumn("_bucket", F.date_trunc(bucket, "_at"))  # times, keys and sizes, read twice
    per = sized.groupBy("_bucket").agg(F.sum("_bytes").alias("_all"))
    newest = Window.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, 0)
    over = per.withColumn("_sum", F.sum("_all").over(newest)).where(F.col("_sum") > budget_bytes)
    edge = over.agg(F.max(F.struct("_bucket", (F.col("_sum") - F.col("_all")).alias("before"))).alias("e")).scalar()
    there = sized.where(F.col("_bucket") == edge["_bucket"]).groupBy("_at", "cache_key").agg(F.sum("_bytes").alias("_bytes"))
    order = [F.desc("_at"), F.desc("cache_key")]
    local = there.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_running, "_at timestamp, cache_key string, _sum long, _part int")
    parts = local.groupBy("_part").agg(F.max("_sum").alias("_all"))  # a row for each partition
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_before"))
    kept = local.join(parts, "_part").where(F.col("_sum") + F.col("_before") + edge["before"] <= budget_bytes)
    last = kept.agg(F.min(F.struct("_at", "cache_key")).alias("c")).scalar()
    here = F.struct(at.alias("_at"), F.coalesce("cache_key", F.lit("")).alias("cache_key"))
    inside = F.date_trunc(bucket, at)
    return store.where(
        edge.isNull() | (inside > edge["_bucket"]) | ((inside == edge["_bucket"]) & F.coalesce(here >= last, F.lit(False)))
    )
