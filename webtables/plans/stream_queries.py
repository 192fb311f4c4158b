"""Registered streaming queries: each runs its stream to completion
(``availableNow``) and returns the sink contents as a DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from webtables.plans.queries import query
from webtables.streaming import jobs as S


@query("t1_running_counters")
def q_t1(spark, d):
    return S.running_counters(spark, d)


@query("t2_windowed_stats")
def q_t2(spark, d):
    return S.windowed_stats(spark, d, size="1 day", watermark="1 day", mode="complete")


@query("t3_ttl_dedup_stream")
def q_t3(spark, d):
    return S.ttl_dedup_stream(spark, d).select("request_id", "label", "fetched_at")


@query("t4_last_n_stream")
def q_t4(spark, d):
    return S.last_n_stream(spark, d, 100).select("request_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "url", "success")


@query("t5_page_conversion_stream")
def q_t5(spark, d):
    return S.page_conversion_stream(spark, d)
