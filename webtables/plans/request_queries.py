"""Registered queries over the request log, attempts and the page store."""

from __future__ import annotations

from pyspark.sql import functions as F

from webtables.functions import text as TX
from webtables.functions import urls as U
from webtables.operators import requests as R
from webtables.operators import store as S
from webtables.operators.freshness import fresh_copy, label_fetches
from webtables.operators.retry import number_attempts, resolve_retries
from webtables.operators.rows import side_by_side
from webtables.plans.queries import query
from webtables.sources import derived as D

# Fixed "now" for repeatable time-relative queries (end of the test month).
NOW = "2024-01-31 00:00:00"
NOW_MID = "2024-01-15 12:00:00"


def _ntz(c):
    return c.cast("timestamp_ntz")


# --- request log --------------------------------------------------------------

@query("s8_request_log")
def q_request_log(spark, d):
    log = D.request_log(spark, d)
    return log.select("request_id", "ts", "url", "success", "status_code", "elapsed_ms", "attempts",
                      "error", "request_type", "cache_key")


@query("a2_counters")
def q_counters(spark, d):
    return R.counters(D.request_log(spark, d)).drop("success_rate", "avg_retries")


@query("a2_counters_by_type")
def q_counters_by_type(spark, d):
    return R.counters(D.request_log(spark, d), ["request_type"]).drop("success_rate", "avg_retries")


@query("a4_success_rate")
def q_rates(spark, d):
    return R.counters(D.request_log(spark, d), ["request_type"]).select(
        "request_type", "success_rate", "avg_retries"
    )


@query("w1_recent_requests")
def q_recent(spark, d):
    return R.recent(D.request_log(spark, d), R.RECENT_REQUESTS).select(
        "request_id", "url", TX.iso_format("ts").alias("timestamp"), "success", "status_code", "attempts"
    )


@query("w1_recent_errors")
def q_recent_errors(spark, d):
    return R.recent(D.request_log(spark, d), R.RECENT_ERRORS, errors_only=True).select(
        "request_id", "url", TX.iso_format("ts").alias("timestamp"), "status_code", "error"
    )


@query("w1_recent_per_type")
def q_recent_per_type(spark, d):
    return R.recent_per_group(D.request_log(spark, d), "request_type", 5).select(
        "request_type", "rank", "request_id"
    )


@query("a6_stats_report")
def q_report(spark, d):
    log = D.request_log(spark, d)
    r = R.stats_report(log)
    return r.select(
        "total", "successful", "failed", "total_retries", "success_rate", "avg_retries",
        F.size("recent_requests").alias("n_recent"), F.get("recent_requests", 0)["request_id"].alias("newest_id"),
        F.size("recent_errors").alias("n_errors"), F.get("recent_errors", 0)["request_id"].alias("newest_error_id"),
    )


@query("p8_request_by_id")
def q_by_id(spark, d):
    log = D.request_log(spark, d)
    return R.by_id(log, 4242).select("request_id", "url", "success", "status_code", "error")


@query("a12_outcome_rollup")
def q_rollup(spark, d):
    return R.outcome_counts(D.request_log(spark, d))


@query("a13_latency")
def q_latency(spark, d):
    return R.latency_summary(D.request_log(spark, d))


@query("a13_rollup_window")
def q_rollup_window(spark, d):
    """A rollup written for all days, then two of them anew; the figures of two weeks of it,
    its estimates beside the exact values."""
    import datetime as dt
    import uuid

    from webtables.operators import rollups as RU
    from webtables.session import checkpoint_dir

    log = D.request_log(spark, d)
    path = f"{checkpoint_dir(spark).rstrip('/')}/rollup-{uuid.uuid4().hex}"
    RU.update_rollup(log, path)
    RU.update_rollup(log, path, [dt.date(2024, 1, 8), dt.date(2024, 1, 9)])
    got = RU.window_figures(spark.read.parquet(path), "2024-01-05", "2024-01-19")
    rows = log.where((F.col("ts") >= "2024-01-05") & (F.col("ts") < "2024-01-19")).join(got.select("request_type", "p50_ms", "p95_ms"), "request_type")
    exact = rows.groupBy("request_type").agg(
        F.count_distinct("url").alias("exact_urls"),
        *[F.avg((F.col("elapsed_ms") <= F.col(c)).cast("int")).alias(f"_{c}") for c in ("p50_ms", "p95_ms")],
    )
    return got.join(exact, "request_type").select(
        "request_type", "n", "successful", "retries", "avg_ms", "min_ms", "max_ms", "exact_urls",
        (F.abs(F.col("urls") - F.col("exact_urls")) <= 0.05 * F.col("exact_urls")).alias("urls_close"),
        (F.col("_p50_ms").between(0.46, 0.54) & F.col("_p95_ms").between(0.91, 0.99)).alias("quantiles_close"),
    )


@query("g10_this_week")
def q_week(spark, d):
    log = D.request_log(spark, d)
    return R.time_frame(log, "this_week", NOW_MID).groupBy("request_type").agg(F.count(F.lit(1)).alias("n"))


@query("h8_duration_text")
def q_duration(spark, d):
    log = D.request_log(spark, d)
    secs = TX.elapsed_seconds(F.col("ts"), NOW)
    return log.select("request_id", F.floor(secs).cast("long").alias("age_s"), TX.format_duration(secs).alias("age"))


@query("h10_iso_time")
def q_iso(spark, d):
    return D.request_log(spark, d).select("request_id", TX.iso_format("ts").alias("timestamp"))


@query("h6_cache_key")
def q_key(spark, d):
    p = D.read_table(spark, d, "pages")
    return p.select("page_id", U.cache_key(F.col("url")).alias("cache_key"))


@query("h7_ttl_class")
def q_ttl(spark, d):
    return D.request_log(spark, d).select("request_id", U.ttl_for_url(F.col("url")).alias("ttl_s"))


# --- attempts and retries --------------------------------------------------------

@query("w4_attempt_numbers")
def q_attempt_no(spark, d):
    return number_attempts(D.attempts(spark, d)).select("request_id", "attempt_no", "ok")


@query("r1_retry_resolution")
def q_retry(spark, d):
    return resolve_retries(D.attempts(spark, d), max_retries=3)


@query("a3_true_retries")
def q_true_retries(spark, d):
    r = resolve_retries(D.attempts(spark, d), max_retries=3)
    return r.agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("retries").cast("long").alias("retries"),
        F.sum(F.col("success").cast("long")).alias("successful"),
        F.sum("backoff_s").alias("backoff_s"),
    )


# --- TTL fold, store ------------------------------------------------------------

@query("r2_fetch_or_served")
def q_r2(spark, d):
    return label_fetches(D.request_log(spark, d)).select("request_id", "label", _ntz(F.col("fetched_at")).alias("fetched_at"))


@query("r2_hits_by_key_class")
def q_r2_hits(spark, d):
    lab = label_fetches(D.request_log(spark, d))
    return lab.groupBy("ttl_s").agg(
        F.sum((F.col("label") == "served").cast("long")).alias("hits"),
        F.sum((F.col("label") == "fetch").cast("long")).alias("misses"),
    )


@query("a7_store_stats")
def q_store_stats(spark, d):
    labelled = label_fetches(D.request_log(spark, d))
    return S.stats_from_totals(D.store_totals(spark, d, labelled))


@query("a6_full_report")
def q_full_report(spark, d):
    """The report with the store's statistics; the lists by their requests, newest first."""
    log = D.request_log(spark, d)
    r = R.stats_report(log, S.stats_from_totals(D.store_totals(spark, d, label_fetches(log))))
    of = lambda c, x: F.array_join(F.transform(c, lambda s: s[x].cast("string")), ",")
    return r.select(
        "total", "successful", "failed", "success_rate", "entry_count", "size_bytes", "hits", "misses", "hit_rate",
        of("recent_requests", "request_id").alias("recent_ids"), of("recent_requests", "url").alias("recent_urls"),
        of("recent_errors", "request_id").alias("error_ids"), of("recent_errors", "status_code").alias("error_codes"),
    )


@query("s10_store_save_and_load")
def q_save_load(spark, d):
    """The store saved, read back, emptied (S6) and read again."""
    import uuid

    from webtables.session import checkpoint_dir

    path = f"{checkpoint_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    S.save_store(D.page_store(spark, d), path)
    back = S.load_store(spark, path)
    S.save_store(S.store_clear(back), path + "-empty")
    left = S.load_store(spark, path + "-empty").agg(F.count(F.lit(1)).alias("after_clear"))
    return side_by_side(back.agg(F.count(F.lit(1)).alias("entries"), F.sum(F.octet_length("content")).alias("bytes"), F.count_distinct("cache_key").alias("keys")), left)


@query("s8_log_append")
def q_log_append(spark, d):
    """The log appended in two halves to a table partitioned by date and read back."""
    import uuid

    from webtables.session import checkpoint_dir

    path = f"{checkpoint_dir(spark).rstrip('/')}/log-{uuid.uuid4().hex}"
    log = D.request_log(spark, d)
    for half in (0, 1):
        R.append_log(log.where(F.col("request_id") % 2 == half), path)
    back = spark.read.parquet(path)
    return back.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.min("request_id").alias("first_id"), F.sum("elapsed_ms").cast("decimal(20,2)").alias("ms"))


@query("p11_id_list")
def q_ids(spark, d):
    return R.reduced_view(_details(spark, d), "ids")


@query("p11_content_view")
def q_content(spark, d):
    return R.reduced_view(_details(spark, d), "content").select("request_id", F.length("content").alias("chars"), F.md5("content").alias("digest"))


def _details(spark, d):
    """Details of all requests against the copies live at NOW_MID, with their fetch records
    (of page ``user_id``) and the answers (request n answers as conversation n % 7 does)."""
    log = D.request_log(spark, d)
    st = D.page_store(spark, d)
    live = st.where((F.col("fetched_at") <= F.lit(NOW_MID).cast("timestamp_ntz")) & S.is_live(NOW_MID))
    live = live.withColumn("metadata", F.struct(F.col("ttl_s"), _ntz(F.col("fetched_at")).cast("string").alias("stored_at")))
    answers = log.where((F.col("request_type") == "answer") & (F.col("request_id") % 3 == 0)).select("request_id", F.struct(F.concat(F.lit("answer "), F.col("request_id").cast("string")).alias("content")).alias("answer"))
    return R.details(log.withColumn("cache_key", F.when(F.col("request_id") % 10 != 0, F.col("cache_key"))), live, answers)


@query("p10_details_unavailable")
def q_unavailable(spark, d):
    return _details(spark, d).select("request_id", "details_unavailable", F.col("answer.content").alias("answer"), "cache_expired", "content_truncated")


@query("h15_comma_list")
def q_comma_list(spark, d):
    from webtables.functions.text import comma_list

    log = D.request_log(spark, d)
    listed = F.concat_ws(" ,", F.col("request_type"), F.lit(""), F.concat(F.lit(" "), F.col("request_id").cast("string")), F.lit("\tx "))
    items = comma_list(listed)
    return log.select("request_id", F.size(items).alias("n"), F.array_join(items, "|").alias("items"))


@query("s3_store_latest")
def q_store_latest(spark, d):
    st = D.page_store(spark, d)
    latest = S.store_write(st.limit(0), st)
    return latest.select("cache_key", _ntz(F.col("fetched_at")).alias("fetched_at"), "ttl_s", F.length("content").alias("chars"))


@query("s7_store_expire")
def q_expire(spark, d):
    live, removed = S.store_expire(D.page_store(spark, d), NOW_MID)
    return side_by_side(live.agg(F.count(F.lit(1)).alias("live")), removed)


@query("s4_store_get")
def q_get(spark, d):
    log = D.request_log(spark, d).select("request_id", "cache_key")
    st = D.page_store(spark, d).where(F.col("fetched_at") <= F.lit(NOW_MID).cast("timestamp_ntz"))
    got = S.store_get(S.store_write(st.limit(0), st), log, NOW_MID, default="")
    return got.groupBy((F.col("content") != "").alias("found")).agg(F.count(F.lit(1)).alias("n"))


@query("s5_store_delete")
def q_delete(spark, d):
    st = D.page_store(spark, d)
    keys = D.request_log(spark, d).where(F.col("url").contains("cdn")).select("cache_key")
    remaining, existed = S.store_delete(st, keys)
    return side_by_side(
        remaining.agg(F.count(F.lit(1)).alias("remaining")),
        existed.agg(F.sum(F.col("existed").cast("long")).alias("existed")),
    )


@query("j2_fresh_copy")
def q_fresh(spark, d):
    log = D.request_log(spark, d)
    st = D.page_store(spark, d)
    fc = fresh_copy(log.select("request_id", "cache_key", "ts", U.ttl_for_url(F.col("url")).alias("ttl_s")), st)
    return fc.select("request_id", _ntz(F.col("fetched_at")).alias("fetched_at"))


@query("j1_request_details")
def q_details(spark, d):
    log = D.request_log(spark, d)
    st = D.page_store(spark, d)
    live = st.where((F.col("fetched_at") <= F.lit(NOW_MID).cast("timestamp_ntz")) & S.is_live(NOW_MID))
    det = R.details(log, live)
    return det.select("request_id", "request_type", "cache_expired", "details_unavailable",
                      F.length("cached_content").alias("preview_chars"), "content_truncated")


@query("w6_retention_budget")
def q_retain(spark, d):
    st = D.page_store(spark, d)
    kept = S.retain_within_budget(st, 2_000_000)
    return kept.select("cache_key", _ntz(F.col("fetched_at")).alias("fetched_at"))


# --- sparse metadata, previews, views, export, ids ---------------------------------

@query("p4_clean_metadata")
def q_clean_meta(spark, d):
    from webtables.operators.pages import clean_metadata

    log = D.request_log(spark, d)
    meta = F.struct(
        F.col("elapsed_ms").alias("elapsed_ms"), F.col("attempts").alias("attempts"),
        (F.col("attempts") - 1).alias("retries"), F.lit(False).alias("from_cache"),
        F.lit(False).alias("proxy_used"), F.lit(None).cast("map<string,string>").alias("proxy_config"),
        F.create_map(F.lit("content-type"), F.lit("text/html")).alias("headers"),
        F.lit(None).cast("boolean").alias("rendered_js"), F.lit(None).cast("map<string,string>").alias("page_metadata"),
    )
    c = clean_metadata(meta, css_selector="article", elements_matched=F.lit(1), include_headers=False)
    return log.select("request_id", c.alias("m")).select(
        "request_id", "m.elapsed_ms", "m.attempts", "m.retries", "m.from_cache", "m.css_selector_applied",
        "m.elements_matched", F.col("m.headers").isNull().alias("headers_dropped"),
    )


@query("p9_preview")
def q_preview(spark, d):
    from webtables.operators.pages import preview

    pv = preview(F.col("html"), 5000)
    return pages_table(spark, d).select(
        "page_id", F.length(pv["content"]).alias("preview_chars"), pv["content_truncated"].alias("content_truncated"),
        pv["full_content_length"].alias("full_content_length"),
    )


@query("p11_metadata_view")
def q_view(spark, d):
    return R.reduced_view(_details(spark, d), "metadata")


@query("s9_json_export")
def q_json(spark, d):
    log = D.request_log(spark, d).select("request_id", "url", "success", "status_code", "attempts", "error")
    return R.to_json_rows(log).select(F.get_json_object("json", "$.request_id").cast("long").alias("request_id"), "json")


@query("h12_query_url")
def q_query_url(spark, d):
    u = U.query_url("https://proxy.example/v1/", {"api_key": "key~1", "url": F.col("url"), "render_js": None, "country": "us"})
    return pages_table(spark, d).select("page_id", u.alias("proxy_url"))


@query("h18_request_id")
def q_req_id(spark, d):
    return D.request_log(spark, d).select("request_id", TX.request_id(F.col("url"), F.col("ts")).alias("rid"))


@query("x4_sql_views")
def q_sql(spark, d):
    from webtables.plans.sql import register

    register(spark, d)
    return spark.sql(
        "SELECT l.page_id, count(*) AS links, max(m.value) AS title "
        "FROM links l JOIN page_meta m ON m.page_id = l.page_id AND m.key = 'title' GROUP BY l.page_id"
    )


def pages_table(spark, d):
    from webtables.sources.tables import pages

    return pages(spark, d)
