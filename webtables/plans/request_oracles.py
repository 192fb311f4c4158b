"""DuckDB oracles for the request-log, retry, TTL and store queries.

The derived views are rebuilt here from ``events`` and ``pages`` with the
FIXTURES.md rules; the TTL fold is a recursive CTE (an independent, row-by-
row formulation of the same semantics)."""

from __future__ import annotations

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
NOW_MID = "TIMESTAMP '2024-01-15 12:00:00'"


def R(x: str, p: int) -> str:
    """Half-up rounding of a double the way Spark does it (decimal text)."""
    return f"CAST(round(CAST({x} AS DECIMAL(38,12)), {p}) AS DOUBLE)"


RL = """
rl AS (
  SELECT event_id AS request_id, ts, url, event_type <> 'error' AS success,
         CAST(CASE WHEN event_type <> 'error' THEN 200 WHEN k % 2 = 0 THEN 429 ELSE 500 END AS INTEGER) AS status_code,
         value AS elapsed_ms,
         CAST(CASE WHEN event_type <> 'error' THEN 1 + k % 4 ELSE 1 END AS INTEGER) AS attempts,
         CASE WHEN event_type = 'error' THEN 'Timeout: ' || k END AS error,
         CASE WHEN event_type = 'purchase' THEN 'answer' ELSE 'scraper' END AS request_type,
         sha256('{"url": "' || url || '"}') AS cache_key, k,
         CAST(regexp_extract(url, '/u/(\\d+)$', 1) AS BIGINT) AS user_id,
         CASE WHEN lower(url) LIKE '%static%' OR lower(url) LIKE '%cdn%' OR lower(url) LIKE '%cloudfront%' THEN 86400
              WHEN lower(url) LIKE '%api%' OR lower(url) LIKE '%realtime%' OR lower(url) LIKE '%live%' THEN 300
              ELSE 3600 END AS ttl_s
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
               'https://' || CASE event_type WHEN 'signup' THEN 'api' WHEN 'view' THEN 'cdn'
                                             WHEN 'purchase' THEN 'live' ELSE 'www' END
               || '.example.com/u/' || CAST(user_id AS VARCHAR) AS url
        FROM events))"""

ATT = RL + """,
tries AS (SELECT *, CASE WHEN success THEN 1 + k % 4 ELSE 4 END AS n FROM rl),
att AS (
  SELECT request_id, ts + to_seconds(CAST(pow(2, i - 1) - 1 AS BIGINT)) AS attempt_ts,
         success AND i = n AS ok, CASE WHEN NOT (success AND i = n) THEN 'Timeout: ' || k END AS error
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM tries))"""

FOLD = RL + """,
o AS (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY ts, request_id) AS rn FROM rl),
f AS (
  SELECT cache_key, rn, request_id, 'fetch' AS label,
         CASE WHEN success THEN ts + to_seconds(ttl_s) END AS exp,
         CASE WHEN success THEN ts END AS fetched_at
  FROM o WHERE rn = 1
  UNION ALL
  SELECT o.cache_key, o.rn, o.request_id,
         CASE WHEN f.exp IS NOT NULL AND o.ts < f.exp THEN 'served' ELSE 'fetch' END,
         CASE WHEN f.exp IS NOT NULL AND o.ts < f.exp THEN f.exp WHEN o.success THEN o.ts + to_seconds(o.ttl_s) END,
         CASE WHEN f.exp IS NOT NULL AND o.ts < f.exp THEN f.fetched_at WHEN o.success THEN o.ts END
  FROM f JOIN o ON o.cache_key = f.cache_key AND o.rn = f.rn + 1),
lab AS (SELECT rl.*, f.label, f.fetched_at FROM rl JOIN f USING (request_id)),
np AS (SELECT count(*) AS n FROM pages),
store AS (
  SELECT lab.cache_key, lab.url, p.html AS content, lab.ts AS fetched_at, lab.ttl_s
  FROM lab, np, pages p
  WHERE lab.label = 'fetch' AND lab.success AND p.page_id = lab.user_id % np.n)"""

ISO = ("CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') "
       "ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') END")

COUNTERS = """count(*) AS total, CAST(sum(CASE WHEN success THEN 1 ELSE 0 END) AS BIGINT) AS successful,
       CAST(sum(CASE WHEN success THEN 0 ELSE 1 END) AS BIGINT) AS failed,
       CAST(sum(greatest(attempts - 1, 0)) AS BIGINT) AS total_retries"""

DUR = """CASE WHEN s < 60 THEN CAST(floor(s) AS BIGINT) || 's'
     WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || 'm ' || CAST(floor(fmod(s, 60)) AS BIGINT) || 's'
     WHEN s < 86400 THEN CAST(floor(s / 3600) AS BIGINT) || 'h ' || CAST(floor(fmod(s, 3600) / 60) AS BIGINT) || 'm'
     ELSE CAST(floor(s / 86400) AS BIGINT) || 'd ' || CAST(floor(fmod(s, 86400) / 3600) AS BIGINT) || 'h' END"""

ORACLES: dict[str, str] = {
    "s8_request_log": f"WITH {RL} SELECT request_id, ts, url, success, status_code, elapsed_ms, attempts, error, request_type, cache_key FROM rl",
    "a2_counters": f"WITH {RL} SELECT {COUNTERS} FROM rl",
    "a2_counters_by_type": f"WITH {RL} SELECT request_type, {COUNTERS} FROM rl GROUP BY request_type",
    "a4_success_rate": f"""WITH {RL}, c AS (SELECT request_type, {COUNTERS} FROM rl GROUP BY request_type)
SELECT request_type, CASE WHEN total = 0 THEN 0.0 ELSE {R('100.0 * successful / total', 2)} END AS success_rate,
       CASE WHEN total = 0 THEN 0.0 ELSE {R('total_retries / total', 2)} END AS avg_retries FROM c""",
    "w1_recent_requests": f"""WITH {RL} SELECT request_id, url, {ISO} AS timestamp, success, status_code, attempts
FROM rl ORDER BY ts DESC, request_id DESC LIMIT 100""",
    "w1_recent_errors": f"""WITH {RL} SELECT request_id, url, {ISO} AS timestamp, status_code, error
FROM rl WHERE NOT success ORDER BY ts DESC, request_id DESC LIMIT 50""",
    "w1_recent_per_type": f"""WITH {RL}, r AS (SELECT request_type, CAST(row_number() OVER (PARTITION BY request_type ORDER BY ts DESC, request_id DESC) AS INTEGER) AS rank, request_id FROM rl)
SELECT * FROM r WHERE rank <= 5""",
    "a6_stats_report": f"""WITH {RL}, c AS (SELECT {COUNTERS} FROM rl)
SELECT c.*, CASE WHEN total = 0 THEN 0.0 ELSE {R('100.0 * successful / total', 2)} END AS success_rate,
       CASE WHEN total = 0 THEN 0.0 ELSE {R('total_retries / total', 2)} END AS avg_retries,
       CAST(least(total, 100) AS INTEGER) AS n_recent,
       (SELECT request_id FROM rl ORDER BY ts DESC, request_id DESC LIMIT 1) AS newest_id,
       CAST(least(failed, 50) AS INTEGER) AS n_errors,
       (SELECT request_id FROM rl WHERE NOT success ORDER BY ts DESC, request_id DESC LIMIT 1) AS newest_error_id
FROM c""",
    "p8_request_by_id": f"WITH {RL} SELECT request_id, url, success, status_code, error FROM rl WHERE request_id = 4242",
    "a12_outcome_rollup": f"WITH {RL} SELECT request_type, status_code, count(*) AS n FROM rl GROUP BY ROLLUP (request_type, status_code)",
    "a13_latency": f"""WITH {RL} SELECT request_type, count(*) AS n, {R('avg(elapsed_ms)', 3)} AS avg_ms,
       min(elapsed_ms) AS min_ms, max(elapsed_ms) AS max_ms,
       {R('list_sort(list(elapsed_ms))[CAST(ceil(0.5 * count(*)) AS BIGINT)]', 3)} AS p50_ms,
       {R('list_sort(list(elapsed_ms))[CAST(ceil(0.95 * count(*)) AS BIGINT)]', 3)} AS p95_ms
FROM rl GROUP BY request_type""",
    "a13_rollup_window": f"""WITH {RL} SELECT request_type, count(*) AS n, CAST(sum(success::INT) AS BIGINT) AS successful,
       CAST(sum(greatest(attempts - 1, 0)) AS BIGINT) AS retries, {R('avg(elapsed_ms)', 3)} AS avg_ms, min(elapsed_ms) AS min_ms, max(elapsed_ms) AS max_ms,
       count(DISTINCT url) AS exact_urls, true AS urls_close, true AS quantiles_close
FROM rl WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-19' GROUP BY request_type""",
    "g10_this_week": f"""WITH {RL} SELECT request_type, count(*) AS n FROM rl
WHERE ts >= date_trunc('week', {NOW_MID}) AND ts <= {NOW_MID} GROUP BY request_type""",
    "h8_duration_text": f"""WITH {RL}, a AS (SELECT request_id, (epoch_us({NOW}) - epoch_us(ts)) / 1e6 AS s FROM rl)
SELECT request_id, CAST(floor(s) AS BIGINT) AS age_s, {DUR} AS age FROM a""",
    "h10_iso_time": f"WITH {RL} SELECT request_id, {ISO} AS timestamp FROM rl",
    "h6_cache_key": "SELECT page_id, sha256('{\"url\": \"' || url || '\"}') AS cache_key FROM pages",
    "h7_ttl_class": f"WITH {RL} SELECT request_id, CAST(ttl_s AS INTEGER) AS ttl_s FROM rl",
    "w4_attempt_numbers": f"""WITH {ATT} SELECT request_id,
       CAST(row_number() OVER (PARTITION BY request_id ORDER BY attempt_ts) AS INTEGER) AS attempt_no, ok FROM att""",
    "r1_retry_resolution": f"""WITH {ATT},
num AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY attempt_ts) AS no FROM att),
lim AS (SELECT * FROM num WHERE no <= 4),
g AS (SELECT request_id, min(no) FILTER (WHERE ok) AS ok_no, max(no) AS last_no,
             arg_max(error, no) AS last_error FROM lim GROUP BY request_id)
SELECT request_id, ok_no IS NOT NULL AS success, CAST(coalesce(ok_no, last_no) AS INTEGER) AS attempts,
       CAST(coalesce(ok_no, last_no) - 1 AS INTEGER) AS retries,
       CASE WHEN ok_no IS NULL THEN last_error END AS error,
       CAST(pow(2, coalesce(ok_no, last_no) - 1) - 1 AS DOUBLE) AS backoff_s
FROM g""",
    "a3_true_retries": f"""WITH {ATT},
num AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY attempt_ts) AS no FROM att),
g AS (SELECT request_id, coalesce(min(no) FILTER (WHERE ok), least(max(no), 4)) AS a, bool_or(ok) AS s FROM num GROUP BY request_id)
SELECT count(*) AS requests, CAST(sum(a - 1) AS BIGINT) AS retries, CAST(sum(CASE WHEN s THEN 1 ELSE 0 END) AS BIGINT) AS successful,
       CAST(sum(pow(2, a - 1) - 1) AS DOUBLE) AS backoff_s FROM g""",
    "r2_fetch_or_served": f"WITH RECURSIVE {FOLD} SELECT request_id, label, fetched_at FROM lab",
    "r2_hits_by_key_class": f"""WITH RECURSIVE {FOLD}
SELECT CAST(ttl_s AS INTEGER) AS ttl_s, CAST(sum(CASE WHEN label = 'served' THEN 1 ELSE 0 END) AS BIGINT) AS hits,
       CAST(sum(CASE WHEN label = 'fetch' THEN 1 ELSE 0 END) AS BIGINT) AS misses FROM lab GROUP BY ttl_s""",
    "a7_store_stats": f"""WITH RECURSIVE {FOLD},
s AS (SELECT count(*) AS entry_count, CAST(coalesce(sum(strlen(content)), 0) AS BIGINT) AS size_bytes FROM store),
h AS (SELECT CAST(sum(CASE WHEN label = 'served' THEN 1 ELSE 0 END) AS BIGINT) AS hits,
             CAST(sum(CASE WHEN label = 'fetch' THEN 1 ELSE 0 END) AS BIGINT) AS misses FROM lab)
SELECT entry_count, size_bytes, {R('size_bytes / 1048576', 2)} AS size_mb, {R('size_bytes / 1073741824 * 100', 2)} AS utilization_percent,
       CAST(1073741824 AS BIGINT) AS size_limit_bytes, 1024.0 AS size_limit_mb,
       size_bytes >= 943718400 AS size_warning, hits, misses,
       CASE WHEN hits + misses > 0 THEN {R('hits / (hits + misses)', 4)} ELSE 0.0 END AS hit_rate
FROM s, h""",
    "s3_store_latest": f"""WITH RECURSIVE {FOLD}
SELECT cache_key, arg_max(fetched_at, fetched_at) AS fetched_at, CAST(arg_max(ttl_s, fetched_at) AS INTEGER) AS ttl_s,
       CAST(arg_max(length(content), fetched_at) AS INTEGER) AS chars FROM store GROUP BY cache_key""",
    "s7_store_expire": f"""WITH RECURSIVE {FOLD}
SELECT count(*) FILTER (WHERE {NOW_MID} < fetched_at + to_seconds(ttl_s)) AS live,
       CAST(count(*) FILTER (WHERE NOT ({NOW_MID} < fetched_at + to_seconds(ttl_s))) AS BIGINT) AS removed FROM store""",
    "s4_store_get": f"""WITH RECURSIVE {FOLD},
latest AS (SELECT cache_key, arg_max(content, fetched_at) AS content, max(fetched_at) AS fetched_at, arg_max(ttl_s, fetched_at) AS ttl_s
           FROM store WHERE fetched_at <= {NOW_MID} GROUP BY cache_key),
live AS (SELECT * FROM latest WHERE {NOW_MID} < fetched_at + to_seconds(ttl_s))
SELECT coalesce(live.content, '') <> '' AS found, count(*) AS n FROM rl LEFT JOIN live USING (cache_key) GROUP BY 1""",
    "s5_store_delete": f"""WITH RECURSIVE {FOLD},
k AS (SELECT DISTINCT cache_key FROM rl WHERE url LIKE '%cdn%')
SELECT (SELECT count(*) FROM store WHERE cache_key NOT IN (SELECT cache_key FROM k)) AS remaining,
       CAST((SELECT count(*) FROM k WHERE cache_key IN (SELECT cache_key FROM store)) AS BIGINT) AS existed""",
    "j2_fresh_copy": f"""WITH RECURSIVE {FOLD},
a AS (SELECT r.request_id, s.fetched_at, s.ttl_s, r.ts FROM rl r ASOF LEFT JOIN store s
      ON s.cache_key = r.cache_key AND r.ts >= s.fetched_at)
SELECT request_id, CASE WHEN ts < fetched_at + to_seconds(ttl_s) THEN fetched_at END AS fetched_at FROM a""",
    "j1_request_details": f"""WITH RECURSIVE {FOLD},
live AS (SELECT * FROM store WHERE fetched_at <= {NOW_MID} AND {NOW_MID} < fetched_at + to_seconds(ttl_s))
SELECT rl.request_id, rl.request_type,
       CASE WHEN rl.request_type <> 'answer' AND live.content IS NULL THEN true END AS cache_expired,
       CASE WHEN rl.request_type = 'answer' THEN 'Perplexity response data not captured'
            WHEN live.content IS NULL THEN 'Content no longer cached' END AS details_unavailable,
       CASE WHEN rl.request_type <> 'answer' THEN CAST(length(substring(live.content, 1, 5000)) AS INTEGER) END AS preview_chars,
       CASE WHEN rl.request_type <> 'answer' AND length(live.content) > 5000 THEN true END AS content_truncated
FROM rl LEFT JOIN live USING (cache_key)""",
    "w6_retention_budget": f"""WITH RECURSIVE {FOLD},
r AS (SELECT cache_key, fetched_at, sum(strlen(content)) OVER (ORDER BY fetched_at DESC, cache_key DESC ROWS UNBOUNDED PRECEDING) AS run FROM store)
SELECT cache_key, fetched_at FROM r WHERE run <= 2000000""",
}


# --- streams (final state equals the batch operators) ---------------------------
ORACLES["t1_running_counters"] = f"""WITH {RL}, c AS (SELECT request_type, {COUNTERS} FROM rl GROUP BY request_type)
SELECT c.*, CASE WHEN total = 0 THEN 0.0 ELSE {R('100.0 * successful / total', 2)} END AS success_rate,
       CASE WHEN total = 0 THEN 0.0 ELSE {R('total_retries / total', 2)} END AS avg_retries FROM c"""
ORACLES["t2_windowed_stats"] = f"""WITH {RL}
SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
       count(*) AS total, CAST(sum(CASE WHEN success THEN 1 ELSE 0 END) AS BIGINT) AS successful,
       CAST(sum(CASE WHEN success THEN 0 ELSE 1 END) AS BIGINT) AS failed,
       CAST(sum(greatest(attempts - 1, 0)) AS BIGINT) AS total_retries
FROM rl GROUP BY 1, 2"""
ORACLES["t3_ttl_dedup_stream"] = ORACLES["r2_fetch_or_served"]
ORACLES["t4_last_n_stream"] = f"""WITH {RL} SELECT request_id, ts, url, success FROM rl ORDER BY ts DESC, request_id DESC LIMIT 100"""

ORACLES["p4_clean_metadata"] = f"""WITH {RL}
SELECT request_id, elapsed_ms, CASE WHEN attempts > 1 THEN attempts END AS attempts,
       CASE WHEN attempts - 1 > 0 THEN attempts - 1 END AS retries, CAST(NULL AS BOOLEAN) AS from_cache,
       'article' AS css_selector_applied, 1 AS elements_matched, true AS headers_dropped FROM rl"""
ORACLES["p9_preview"] = """
SELECT page_id, CAST(length(substring(html, 1, 5000)) AS INT) AS preview_chars,
       CASE WHEN length(html) > 5000 THEN true END AS content_truncated,
       CASE WHEN length(html) > 5000 THEN CAST(length(html) AS INT) END AS full_content_length FROM pages"""
DETAILS = f"""{FOLD},
live AS (SELECT * FROM store WHERE fetched_at <= {NOW_MID} AND {NOW_MID} < fetched_at + to_seconds(ttl_s)),
q AS (SELECT rl.* REPLACE (CASE WHEN request_id % 10 <> 0 THEN cache_key END AS cache_key) FROM rl),
d AS (SELECT q.*, q.request_type = 'answer' AS is_answer, live.content, {ISO.replace('ts', 'q.ts')} AS timestamp,
             CASE WHEN live.content IS NOT NULL THEN '{{"ttl_s":' || CAST(live.ttl_s AS INT) || ',"stored_at":"' || rtrim(rtrim(strftime(live.fetched_at, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') || '"}}' END AS meta,
             CASE WHEN q.request_type = 'answer' AND request_id % 3 = 0 THEN 'answer ' || request_id END AS answer
      FROM q LEFT JOIN live ON live.cache_key = q.cache_key)"""
ORACLES["p11_metadata_view"] = f"""WITH RECURSIVE {DETAILS}
SELECT request_id, url, timestamp, request_type, success, status_code, elapsed_ms, attempts, error, CASE WHEN NOT is_answer THEN meta END AS cached_metadata FROM d"""
ORACLES["p11_id_list"] = f"""WITH RECURSIVE {DETAILS}
SELECT request_id, url, timestamp, request_type, success, CASE WHEN NOT is_answer THEN cache_key END AS cache_key FROM d"""
ORACLES["p11_content_view"] = f"""WITH RECURSIVE {DETAILS},
c AS (SELECT request_id, coalesce(CASE WHEN NOT is_answer THEN substring(content, 1, 5000) END, answer, '') AS c FROM d)
SELECT request_id, CAST(length(c) AS INT) AS chars, md5(c) AS digest FROM c"""
ORACLES["p10_details_unavailable"] = f"""WITH RECURSIVE {DETAILS}
SELECT request_id, answer, CASE WHEN is_answer THEN CASE WHEN answer IS NULL THEN 'Perplexity response data not captured' END
            WHEN cache_key IS NULL THEN 'Cache key not available' WHEN content IS NULL THEN 'Content no longer cached' END AS details_unavailable,
       CASE WHEN NOT is_answer AND cache_key IS NOT NULL AND content IS NULL THEN true END AS cache_expired,
       CASE WHEN NOT is_answer AND length(content) > 5000 THEN true END AS content_truncated FROM d"""
ORACLES["a6_full_report"] = f"""WITH RECURSIVE {FOLD}, c AS (SELECT {COUNTERS} FROM rl),
s AS (SELECT count(*) AS entry_count, CAST(coalesce(sum(strlen(content)), 0) AS BIGINT) AS size_bytes FROM store),
h AS (SELECT CAST(sum(CASE WHEN label = 'served' THEN 1 ELSE 0 END) AS BIGINT) AS hits, CAST(sum(CASE WHEN label = 'fetch' THEN 1 ELSE 0 END) AS BIGINT) AS misses FROM lab),
r AS (SELECT * FROM rl ORDER BY ts DESC, request_id DESC LIMIT 100), e AS (SELECT * FROM rl WHERE NOT success ORDER BY ts DESC, request_id DESC LIMIT 50)
SELECT total, successful, failed, CASE WHEN total = 0 THEN 0.0 ELSE {R('100.0 * successful / total', 2)} END AS success_rate, entry_count, size_bytes, hits, misses,
       CASE WHEN hits + misses > 0 THEN {R('hits / (hits + misses)', 4)} ELSE 0.0 END AS hit_rate,
       (SELECT string_agg(request_id, ',' ORDER BY ts DESC, request_id DESC) FROM r) AS recent_ids,
       (SELECT string_agg(url, ',' ORDER BY ts DESC, request_id DESC) FROM r) AS recent_urls,
       (SELECT string_agg(request_id, ',' ORDER BY ts DESC, request_id DESC) FROM e) AS error_ids,
       (SELECT string_agg(status_code, ',' ORDER BY ts DESC, request_id DESC) FROM e) AS error_codes
FROM c, s, h"""
ORACLES["s10_store_save_and_load"] = f"""WITH RECURSIVE {FOLD}
SELECT count(*) AS entries, CAST(sum(strlen(content)) AS BIGINT) AS bytes, count(DISTINCT cache_key) AS keys, CAST(0 AS BIGINT) AS after_clear FROM store"""
ORACLES["s8_log_append"] = f"""WITH {RL}
SELECT CAST(ts AS DATE) AS date, count(*) AS n, min(request_id) AS first_id, CAST(sum(elapsed_ms) AS DECIMAL(20,2)) AS ms FROM rl GROUP BY 1"""
ORACLES["h15_comma_list"] = f"""WITH {RL} SELECT request_id, CAST(4 AS INT) AS n, request_type || '||' || request_id || '|x' AS items FROM rl"""
ORACLES["s9_json_export"] = f"""WITH {RL}
SELECT request_id, '{{"request_id":' || request_id || ',"url":"' || url || '","success":' || CASE WHEN success THEN 'true' ELSE 'false' END
       || ',"status_code":' || status_code || ',"attempts":' || attempts
       || CASE WHEN error IS NULL THEN '' ELSE ',"error":"' || error || '"' END || '}}' AS json FROM rl"""
ORACLES["h12_query_url"] = """
SELECT page_id, 'https://proxy.example/v1/?api_key=key~1&url=' || replace(url_encode(url), '%20', '+') || '&country=us' AS proxy_url
FROM pages"""
ORACLES["h18_request_id"] = f"WITH {RL} SELECT request_id, sha256(url || '#' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f')) AS rid FROM rl"
ORACLES["x4_sql_views"] = """
SELECT page_id, count(*) AS links,
       max(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&')) AS title
FROM (SELECT page_id, html, unnest(regexp_extract_all(html, '<a\\s[^>]*href=')) AS a FROM pages) GROUP BY page_id"""
