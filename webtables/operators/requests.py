"""Request-log jobs: counters and rates (A2-A6), recent lists (W1, L1),
lookups and reduced views (P8-P11, J1), outcome classes (A12, C2), latency
(A13), time frames (G10), append and JSON export (S8, S9).

Counters are aggregates over the log, never mutable state: partial
aggregation runs map-side, so a whole-log count is one small shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtables.functions.text import iso_format, pct, ratio
from webtables.operators.pages import preview

# List sizes and preview length.
RECENT_REQUESTS = 100
RECENT_ERRORS = 50
PREVIEW_CHARS = 5000
# Answer-service error prefixes and their status codes.
RATE_LIMITED = "Rate limit exceeded"
BAD_REQUEST = "Bad request"
UNAVAILABLE = "service not available"
# Detail texts.
NOT_CAPTURED = "Perplexity response data not captured"
NO_LONGER_CACHED = "Content no longer cached"
KEY_NOT_AVAILABLE = "Cache key not available"


def counters(log: DataFrame, by: list[str] | None = None, retries_of_fetches_only: bool = False) -> DataFrame:
    """A2-A5: total, successful, failed, total_retries, success_rate (percent,
    2 places, 0.0 when empty), avg_retries (2 places, 0.0 when empty).
    ``total_retries`` is ``sum(attempts-1 where attempts>1)`` as logged. A
    served request re-logs the attempts of the fetch that stored its copy;
    with ``retries_of_fetches_only`` (needs R2's ``label``) only fetches
    count."""
    retries = F.greatest(F.col("attempts") - 1, F.lit(0))
    if retries_of_fetches_only:
        retries = F.when(F.col("label") == "fetch", retries).otherwise(F.lit(0))
    aggs = [
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum(F.col("success").cast("long")), F.lit(0)).alias("successful"),
        F.coalesce(F.sum((~F.col("success")).cast("long")), F.lit(0)).alias("failed"),
        F.coalesce(F.sum(retries), F.lit(0)).cast("long").alias("total_retries"),
    ]
    g = log.groupBy(*by) if by else log
    out = g.agg(*aggs)
    return out.withColumn("success_rate", pct("successful", "total")).withColumn(
        "avg_retries", ratio("total_retries", "total")
    )


def _recent_struct(errors: bool) -> Column:
    fields = [
        F.col("ts"),
        F.col("request_id"),
        F.col("url"),
        iso_format("ts").alias("timestamp"),
    ]
    if not errors:
        fields.append(F.col("success"))
    fields += [F.col("status_code")]
    if not errors:
        fields.append(F.col("elapsed_ms"))
    fields += [F.col("attempts"), F.col("error"), F.col("request_type")]
    return F.struct(*fields)


def recent(log: DataFrame, n: int = RECENT_REQUESTS, errors_only: bool = False) -> DataFrame:
    """The last ``n`` requests (or errors), newest first. A top-k:
    each task keeps its own ``n`` best, so only ``n`` rows per task move."""
    src = log.where(~F.col("success")) if errors_only else log
    return src.orderBy(F.col("ts").desc(), F.col("request_id").desc()).limit(n)


def recent_per_group(log: DataFrame, group: str, n: int, salts: int = 64) -> DataFrame:
    """W1 per group: the newest ``n`` rows of each group, ranked 1..n
    (exact two-stage top-k, see ``rows.top_k_per_group``)."""
    from webtables.operators.rows import top_k_per_group

    order = [F.col("ts").desc(), F.col("request_id").desc()]
    return top_k_per_group(log, [group], order, n, "request_id", salts)


def _as_list(top: DataFrame, name: str, errors: bool) -> DataFrame:
    """A bounded top-n frame as one array column, newest first."""
    return top.agg(
        F.transform(
            F.sort_array(F.collect_list(_recent_struct(errors)), asc=False),
            lambda s: s.dropFields("ts"),
        ).alias(name)
    )


def stats_report(log: DataFrame, store_stats: DataFrame | None = None) -> DataFrame:
    """One row with the counters, the recent lists and the store stats.
    Every part is a one-row aggregate, so the joins pair single rows."""
    c = counters(log)
    parts = [
        c,
        _as_list(recent(log, RECENT_REQUESTS), "recent_requests", False),
        _as_list(recent(log, RECENT_ERRORS, errors_only=True), "recent_errors", True),
    ]
    if store_stats is not None:
        parts.append(store_stats)
    from webtables.operators.rows import side_by_side

    return side_by_side(*parts)


def by_id(log: DataFrame, request_id, within_last: int | None = None) -> DataFrame:
    """The request with this id (empty frame when absent). The whole log
    is searched unless ``within_last`` limits it to the newest n."""
    src = recent(log, within_last) if within_last else log
    return src.where(F.col("request_id") == F.lit(request_id))


def details(log: DataFrame, live_store: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Request details. Answer requests carry their payload (or
    "not captured"); page requests show the stored content preview, or
    "no longer cached" with ``cache_expired``, or "key not available"."""
    # pages are cut to the preview before they meet the log
    cut = F.when(F.col("content").isNotNull(), preview(F.col("content"), PREVIEW_CHARS))
    kept = F.to_json("metadata") if "metadata" in live_store.columns else F.lit(None).cast("string")
    store = live_store.select("cache_key", cut.alias("stored"), kept.alias("stored_metadata"))
    j = log.join(store, "cache_key", "left")
    if answers is not None:
        j = j.join(answers, "request_id", "left")
    else:
        j = j.withColumn("answer", F.lit(None).cast("struct<content:string>"))
    is_answer = F.col("request_type") == "answer"
    pv = F.col("stored")
    has_key = F.col("cache_key").isNotNull()
    hit = pv.isNotNull()
    unavailable = (
        F.when(is_answer, F.when(F.col("answer").isNull(), F.lit(NOT_CAPTURED)))
        .when(~has_key, F.lit(KEY_NOT_AVAILABLE))
        .when(~hit, F.lit(NO_LONGER_CACHED))
    )
    return j.select(
        "request_id",
        "request_type",
        "url",
        iso_format("ts").alias("timestamp"),
        "success",
        "status_code",
        "elapsed_ms",
        "attempts",
        "error",
        F.when(~is_answer, F.col("cache_key")).alias("cache_key"),
        F.when(is_answer, F.col("answer")).alias("answer"),
        F.when(~is_answer & hit, pv["content"]).alias("cached_content"),
        F.when(~is_answer & hit, pv["content_truncated"]).alias("content_truncated"),
        F.when(~is_answer & hit, pv["full_content_length"]).alias("full_content_length"),
        F.when(~is_answer & has_key & ~hit, F.lit(True)).alias("cache_expired"),
        unavailable.alias("details_unavailable"),
        F.when(~is_answer, F.col("stored_metadata")).alias("cached_metadata"),
    )


def reduced_view(detail: DataFrame, view: str) -> DataFrame:
    """The views of :func:`details`: ``ids`` (the list of requests), ``full``,
    ``content`` (the stored content or the answer's, empty without one) and ``metadata``
    (with the stored fetch metadata as JSON, where there is some)."""
    if view == "ids":
        return detail.select("request_id", "url", "timestamp", "request_type", "success", "cache_key")
    if view == "full":
        return detail
    if view == "content":
        return detail.select("request_id", F.coalesce("cached_content", F.col("answer.content"), F.lit("")).alias("content"))
    if view == "metadata":
        return detail.select("request_id", "url", "timestamp", "request_type", "success", "status_code", "elapsed_ms", "attempts", "error", "cached_metadata")
    raise ValueError(view)


def outcome_class(error: Column) -> Column:
    """Error text prefix -> status code of the answer service."""
    return (
        F.when(error.isNull(), F.lit(200))
        .when(error.startswith(RATE_LIMITED), F.lit(429))
        .when(error.startswith(BAD_REQUEST), F.lit(400))
        .when(error.contains(UNAVAILABLE), F.lit(503))
        .otherwise(F.lit(500))
    )


def outcome_counts(log: DataFrame) -> DataFrame:
    """Counts by request type and status, with rollup subtotals."""
    return log.rollup("request_type", "status_code").agg(F.count(F.lit(1)).alias("n"))


def latency_summary(log: DataFrame, by: str = "request_type", accuracy: int = 1_000_000) -> DataFrame:
    """Latency summary with ``percentile_approx`` (a bounded sketch per
    group, merged map-side; exact ``percentile`` would keep every value of
    a group in one task). The result is a data value whose rank error is at
    most n/accuracy."""
    def q(c, p):
        return F.percentile_approx(c, p, accuracy)

    return log.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("elapsed_ms"), 3).alias("avg_ms"),
        F.min("elapsed_ms").alias("min_ms"),
        F.max("elapsed_ms").alias("max_ms"),
        F.round(q(F.col("elapsed_ms"), F.lit(0.5)), 3).alias("p50_ms"),
        F.round(q(F.col("elapsed_ms"), F.lit(0.95)), 3).alias("p95_ms"),
    )


def time_frame(log: DataFrame, frame: str, now: str, recent_n: int = 100) -> DataFrame:
    """Rows in ``today``, ``this_week``, ``this_month`` relative to
    ``now`` (a parameter), or the newest ``recent_n`` for ``recent``."""
    if frame == "recent":
        return recent(log, recent_n)
    import datetime as dt

    unit = {"today": "day", "this_week": "week", "this_month": "month"}[frame]
    end = dt.datetime.fromisoformat(now)
    start = end.replace(hour=0, minute=0, second=0, microsecond=0)
    if unit == "week":
        start -= dt.timedelta(days=start.weekday())
    elif unit == "month":
        start = start.replace(day=1)
    # bounds are literals of the column's own type, so the filter reaches
    # the parquet scan (and partition pruning on a date-partitioned log)
    typ = log.schema["ts"].dataType
    return log.where((F.col("ts") >= F.lit(start).cast(typ)) & (F.col("ts") <= F.lit(end).cast(typ)))


def append_log(log: DataFrame, path: str) -> None:
    """Append to a date-partitioned parquet log."""
    log.withColumn("date", F.to_date("ts")).write.mode("append").partitionBy("date").parquet(path)


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON document per row (null fields omitted)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
