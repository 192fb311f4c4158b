"""Retry resolution from a per-try log.

Within ``max_retries + 1`` tries a request stops at its first success or at
the first error that is not retried; otherwise it ends with the last error.
Retried errors are timeouts, connection errors and HTTP status errors. Only the
first ``max_retries + 1`` tries per request are kept (salted two-stage
top-k), then one aggregate per request resolves the outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webtables.functions.text import total_backoff

# Error prefixes that are retried.
RETRIED_PREFIXES = ["Timeout", "ConnectionError", "HTTPError"]


def is_retried(error: Column) -> Column:
    c = F.lit(False)
    for p in RETRIED_PREFIXES:
        c = c | error.startswith(p)
    return c


def number_attempts(tries: DataFrame) -> DataFrame:
    """``attempt_no`` = 1, 2, ... per request in time order; of equal times failures
    first (a request ends with its success), then by error text."""
    w = Window.partitionBy("request_id").orderBy("attempt_ts", "ok", F.asc_nulls_last("error"))
    return tries.withColumn("attempt_no", F.row_number().over(w))


def resolve_retries(tries: DataFrame, max_retries: int = 3, retry_delay: float = 1.0) -> DataFrame:
    """``request_id, success, attempts, retries, error, backoff_s``."""
    from webtables.operators.rows import top_k_per_group

    # only the first max_retries+1 tries matter: an exact salted top-k, so
    # even a request with a huge try log is never ranked in one task
    numbered = top_k_per_group(
        tries, ["request_id"], [F.col("attempt_ts"), F.col("ok"), F.asc_nulls_last("error")], max_retries + 1,
        "attempt_ts", salts=16, rank_col="attempt_no",
    )
    stop = F.col("ok") | ~is_retried(F.coalesce(F.col("error"), F.lit("")))
    agg = numbered.groupBy("request_id").agg(
        F.min(F.when(stop, F.col("attempt_no"))).alias("stop_no"),
        F.max("attempt_no").alias("last_no"),
        F.min(F.when(F.col("ok"), F.col("attempt_no"))).alias("ok_no"),
        F.max_by(F.struct("attempt_no", "error"), "attempt_no").alias("last"),
        F.min_by(F.struct("attempt_no", "error"), F.when(stop, F.col("attempt_no"))).alias("first_stop"),
    )
    attempts = F.coalesce(F.col("stop_no"), F.col("last_no"))
    success = F.col("ok_no").isNotNull() & (F.col("ok_no") == attempts)
    error = F.when(~success, F.when(F.col("stop_no").isNotNull(), F.col("first_stop.error")).otherwise(F.col("last.error")))
    retries = attempts - 1
    return agg.select(
        "request_id",
        success.alias("success"),
        attempts.cast("int").alias("attempts"),
        retries.cast("int").alias("retries"),
        error.alias("error"),
        total_backoff(retries, retry_delay).alias("backoff_s"),
    )
