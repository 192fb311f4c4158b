"""Retry resolution, counters, the TTL fold and the store (FIXTURES.md cases)."""

import datetime as dt
import hashlib

import pytest

from pyspark.sql import functions as F

from webtables.functions import text as TX
from webtables.operators import store as S
from webtables.operators.freshness import label_fetches
from webtables.operators.requests import by_id, counters, recent
from webtables.operators.retry import resolve_retries

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def tries(spark, rows):
    data = [(rid, T0 + dt.timedelta(seconds=i), ok, err) for rid, i, ok, err in rows]
    return spark.createDataFrame(data, "request_id long, attempt_ts timestamp_ntz, ok boolean, error string")


def test_retry_cases(spark):
    rows = [
        (1, 0, False, "Timeout: a"), (1, 1, False, "Timeout: b"), (1, 3, True, None),          # 3 / 2
        (2, 0, False, "ConnectionError: x"), (2, 1, True, None),                                # 2 / 1
        (3, 0, True, None),                                                                     # 1 / 0
        (4, 0, False, "Timeout: 1"), (4, 1, False, "Timeout: 2"), (4, 3, False, "Timeout: 3"),  # exhausted
        (5, 0, False, "ValueError: bad"), (5, 1, True, None),                                   # not retried
    ]
    out = {r.request_id: r for r in resolve_retries(tries(spark, rows), max_retries=2).collect()}
    assert (out[1].success, out[1].attempts, out[1].retries, out[1].backoff_s) == (True, 3, 2, 3.0)
    assert (out[2].success, out[2].attempts, out[2].retries) == (True, 2, 1)
    assert (out[3].success, out[3].attempts, out[3].retries, out[3].error) == (True, 1, 0, None)
    assert (out[4].success, out[4].attempts, out[4].error) == (False, 3, "Timeout: 3")
    assert (out[5].success, out[5].attempts, out[5].error) == (False, 1, "ValueError: bad")


def test_custom_retry_limit(spark):
    rows = [(9, i, False, f"Timeout: {i}") for i in range(4)] + [(9, 10, True, None)]
    r = resolve_retries(tries(spark, rows), max_retries=5).first()
    assert (r.success, r.attempts, r.retries) == (True, 5, 4)


def test_counters_empty_and_rates(spark):
    empty = spark.createDataFrame([], "request_id long, ts timestamp_ntz, success boolean, attempts int")
    r = counters(empty).first()
    assert (r.total, r.successful, r.failed, r.total_retries, r.success_rate, r.avg_retries) == (0, 0, 0, 0, 0.0, 0.0)
    log = spark.createDataFrame([(1, T0, True, 3), (2, T0, False, 1), (3, T0, True, 1)],
                                "request_id long, ts timestamp_ntz, success boolean, attempts int")
    r = counters(log).first()
    assert (r.total, r.successful, r.failed, r.total_retries, r.success_rate, r.avg_retries) == (3, 2, 1, 2, 66.67, 0.67)
    assert by_id(log, 99).count() == 0 and by_id(log, 2).first().success is False
    assert [x.request_id for x in recent(log, 2).collect()] == [3, 2]


def python_fold(rows, ttl):
    """Brute-force reference: one key, rows sorted by (ts, id)."""
    out, exp = {}, None
    for rid, ts, ok in sorted(rows, key=lambda r: (r[1], r[0])):
        if exp is not None and ts < exp:
            out[rid] = "served"
        else:
            out[rid] = "fetch"
            exp = ts + ttl if ok else None
    return out


def test_fold_matches_brute_force(spark):
    import random

    rnd = random.Random(7)
    rows = []
    for key in range(6):
        t = 0
        for i in range(60):
            t += rnd.choice([0, 1, 5, 30, 200, 400, 4000])
            rows.append((key * 1000 + i, key, t, rnd.random() > 0.3))
    data = [(rid, T0 + dt.timedelta(seconds=t), f"https://www.example.com/u/{k}", ok, f"k{k}") for rid, k, t, ok in rows]
    log = spark.createDataFrame(data, "request_id long, ts timestamp_ntz, url string, success boolean, cache_key string")
    got = {r.request_id: r.label for r in label_fetches(log).collect()}
    exp = {}
    for k in range(6):
        exp.update(python_fold([(rid, t, ok) for rid, kk, t, ok in rows if kk == k], 3600))
    assert got == exp


@pytest.mark.parametrize("segment_rows", [1, 7, 50, 10**6])
def test_steady_traffic_is_cut_into_segments(spark, segment_rows):
    """One key whose copies follow each other without a gap, bursts and equal times among
    them: the labels are those of the fold however the run is cut."""
    import random

    rnd = random.Random(11)
    rows, t = [], 0
    for i in range(1500):
        t += rnd.choice([0, 0, 1, 7, 40, 300, 1100])
        rows.append((i if i % 9 else 10_000 - i, t, rnd.random() > 0.2))
    data = [(rid, T0 + dt.timedelta(seconds=x), "https://www.example.com/u/1", ok, "k") for rid, x, ok in rows]
    log = spark.createDataFrame(data, "request_id long, ts timestamp_ntz, url string, success boolean, cache_key string")
    labelled = label_fetches(log, segment_rows=segment_rows).collect()
    assert {r.request_id: r.label for r in labelled} == python_fold(rows, 3600)
    at, stored = {rid: x for rid, x, _ in rows}, None
    for r in sorted(labelled, key=lambda r: (at[r.request_id], r.request_id)):
        if r.label == "fetch":
            stored = r.ts if r.success else None
        assert r.fetched_at == stored


def test_step_function_of_a_segment():
    import numpy as np

    from webtables.operators.freshness import step_function, walk

    rnd = np.random.default_rng(5)
    for _ in range(50):
        ts = np.unique(rnd.integers(100, 400, rnd.integers(1, 60)))
        bounds, stores = step_function(ts, 30, 130)
        for e in range(90, 130):
            found = walk(ts, np.full(len(ts), 30), np.array([0]), np.array([e]))
            j = int(np.searchsorted(bounds, e))
            assert (ts[found[-1]] if len(found) else None) == (stores[j] if j < len(bounds) else None)


def test_expiry_edge_and_store_ops(spark, tmp_path):
    st = spark.createDataFrame(
        [("a", "u", "A", T0, 1), ("b", "u", "B", T0, None), ("a", "u", "A2", T0 - dt.timedelta(seconds=5), 1)],
        "cache_key string, url string, content string, fetched_at timestamp_ntz, ttl_s int",
    )
    latest = S.store_write(st.limit(0), st)
    assert {r.cache_key: r.content for r in latest.collect()} == {"a": "A", "b": "B"}
    keys = spark.createDataFrame([("a",), ("b",), ("zz",)], "cache_key string")
    at = lambda s: (T0 + dt.timedelta(seconds=s)).strftime("%Y-%m-%d %H:%M:%S.%f")
    got0 = {r.cache_key: r.content for r in S.store_get(latest, keys, at(0), default="-").collect()}
    assert got0 == {"a": "A", "b": "B", "zz": "-"}
    got1 = {r.cache_key: r.content for r in S.store_get(latest, keys, at(1.1), default="-").collect()}
    assert got1 == {"a": "-", "b": "B", "zz": "-"}  # expired at fetched_at + ttl (strict <)
    live, removed = S.store_expire(latest, at(2))
    assert live.count() == 1 and removed.first().removed == 1
    remaining, existed = S.store_delete(latest, keys)
    assert remaining.count() == 0
    assert {r.cache_key: r.existed for r in existed.collect()} == {"a": True, "b": True, "zz": False}
    assert S.store_clear(latest).count() == 0
    path = str(tmp_path / "store")
    S.save_store(latest, path)
    assert S.load_store(spark, path).count() == 2  # persistence across sessions


def test_store_write_chooses_before_contents_are_joined(spark):
    """The newest row of a key is chosen by times below the join that brings contents; ties
    go to the new row, then to the content that sorts last; times may be null."""
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [("a", 1, at(0)), ("a", 2, at(5)), ("b", 1, at(1)), ("b", 2, at(1)), ("b", 2, at(1)), ("c", 3, None), ("d", 3, None), ("d", 1, at(0)), (None, 1, at(9))]
    keys = spark.createDataFrame(rows, "cache_key string, page long, fetched_at timestamp_ntz")
    texts = spark.createDataFrame([(1, "one"), (2, "two"), (3, None)], "page long, content string")
    new = keys.join(texts.hint("merge"), "page").select("cache_key", F.lit("u").alias("url"), "content", "fetched_at", F.lit(60).alias("ttl_s"))
    old = spark.createDataFrame([("a", "u", "old", at(5), 1), ("c", "u", "kept", at(-9), 1), ("e", "u", "e", None, None)], "cache_key string, url string, content string, fetched_at timestamp_ntz, ttl_s int")
    latest = S.store_write(old, new)
    assert latest.columns == old.columns
    by_digest = max(("one", "two"), key=lambda x: hashlib.sha256(x.encode()).hexdigest())
    want = [("a", "two", at(5), 60), ("b", by_digest, at(1), 60), ("c", "kept", at(-9), 1), ("d", "one", at(0), 60), ("e", "e", None, None)]
    assert sorted(tuple(r)[:1] + tuple(r)[2:] for r in latest.collect()) == want
    plan = S.store_write(new.limit(0), new)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("Join Inner") < plan.index("Join LeftSemi")


def test_retention_budget_matches_running_sum(spark):
    rows = [(f"k{i}", "u", "x" * (10 + i), T0 + dt.timedelta(minutes=17 * i), 60) for i in range(40)]
    st = spark.createDataFrame(rows, "cache_key string, url string, content string, fetched_at timestamp_ntz, ttl_s int")
    budget = 500
    kept = {r.cache_key for r in S.retain_within_budget(st, budget).collect()}
    run, exp = 0, set()
    for k, _, c, f, _ in sorted(rows, key=lambda r: (r[3], r[0]), reverse=True):
        run += len(c)
        if run <= budget:
            exp.add(k)
    assert kept == exp


def test_retention_when_one_hour_holds_everything(spark):
    """Equal times go by key, rows equal in both stay or go together, odd budgets."""
    rows = [(f"k{i % 180:03d}", "x" * (i % 7), T0 + dt.timedelta(microseconds=i % 60)) for i in range(200)]
    rows += [("n", None, T0), (None, "xy", T0), ("old", "x", None), ("late", "x" * 5, T0 + dt.timedelta(hours=2))]
    st = spark.createDataFrame(rows, "cache_key string, content string, fetched_at timestamp_ntz").repartition(4)
    early = dt.datetime(1, 1, 1)
    groups = {}
    for k, c, f in rows:
        groups.setdefault((f or early, k or ""), []).append((k, c, f))
    key = lambda r: tuple(map(str, r))
    for budget in (-1, 0, 4, 5, 6, 100, 333, 10**6):
        run, want = 0, []
        for g in sorted(groups, reverse=True):
            run += sum(len(c or "") for _, c, _ in groups[g])
            if run > budget:
                break
            want += groups[g]
        got = [(r.cache_key, r.content, r.fetched_at) for r in S.retain_within_budget(st, budget).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    assert S.retain_within_budget(st.limit(0), 5).collect() == []


def test_text_functions(spark):
    df = spark.createDataFrame([(5.0,), (65.0,), (3725.0,), (90061.0,)], "s double")
    assert [r[0] for r in df.select(TX.format_duration("s")).collect()] == ["5s", "1m 5s", "1h 2m", "1d 1h"]
    ts = spark.createDataFrame([(T0,), (T0 + dt.timedelta(microseconds=5),)], "t timestamp_ntz")
    assert [r[0] for r in ts.select(TX.iso_format("t")).collect()] == [
        "2024-01-01T00:00:00+00:00", "2024-01-01T00:00:00.000005+00:00"]
    s = spark.createDataFrame([("  a  \n b  ",), ("x" * 100,)], "s string")
    out = [r[0] for r in s.select(TX.truncate_ellipsis(TX.collapse_ws("s"))).collect()]
    assert out == ["a b", "x" * 77 + "..."]
    k = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert [r[0] for r in k.select(TX.backoff_delay("k")).collect()] == [1.0, 2.0, 4.0]
    assert [r[0] for r in k.select(TX.total_backoff("k")).collect()] == [1.0, 3.0, 7.0]


def test_day_rollups_merge_over_any_window(spark, tmp_path):
    """A window merged from day rows equals the log's own figures, estimates within their
    stated errors; a late day is rewritten alone."""
    from webtables.operators import rollups as RU

    rows = [(i, T0 + dt.timedelta(minutes=37 * i), f"https://a.example/{i % 700}", i % 5 > 0, float(i * 7919 % 1000), 1 + i % 3, "x" if i % 4 else "y") for i in range(2000)]
    rows += [(5000, None, "u", True, 1.0, 1, "x"), (5001, T0, None, False, None, 2, "z")]
    log = spark.createDataFrame(rows, "request_id long, ts timestamp_ntz, url string, success boolean, elapsed_ms double, attempts int, request_type string")
    path = str(tmp_path / "rollup")
    RU.update_rollup(log.where("request_id % 2 = 0"), path)
    days = [T0.date() + dt.timedelta(days=k) for k in range(60)]
    RU.update_rollup(log, path, days[:30])
    RU.update_rollup(log, path, days[30:])
    for a, b in ((0, 60), (3, 17), (40, 41)):
        got = {r.request_type: r for r in RU.window_figures(spark.read.parquet(path), days[a], days[b] if b < 60 else "2030-01-01").collect()}
        inside = [r for r in rows if r[1] and days[a] <= r[1].date() and (b == 60 or r[1].date() < days[b])]
        assert set(got) == {r[6] for r in inside}
        for kind, g in got.items():
            mine = [r for r in inside if r[6] == kind]
            times = sorted(r[4] for r in mine if r[4] is not None)
            assert (g.n, g.successful, g.retries) == (len(mine), sum(r[3] for r in mine), sum(r[5] - 1 for r in mine))
            assert (g.min_ms, g.max_ms) == ((times[0], times[-1]) if times else (None, None))
            urls = len({r[2] for r in mine if r[2]})
            assert abs(g.urls - urls) <= max(1, 0.05 * urls)
            if len(times) > 20:
                assert abs(sum(t <= g.p50_ms for t in times) / len(times) - 0.5) < 0.05
            elif not times:
                assert g.p50_ms is None


def test_two_stage_top_k_equals_window(spark):
    from pyspark.sql import Window

    from webtables.operators.requests import recent_per_group

    rows = [(i, T0 + dt.timedelta(seconds=(i * 37) % 500), "a" if i % 3 else "b") for i in range(400)]
    log = spark.createDataFrame(rows, "request_id long, ts timestamp_ntz, g string")
    got = {(r.g, r.rank, r.request_id) for r in recent_per_group(log, "g", 7, salts=5).collect()}
    w = Window.partitionBy("g").orderBy(F.col("ts").desc(), F.col("request_id").desc())
    exp = {(r.g, r.rank, r.request_id) for r in log.withColumn("rank", F.row_number().over(w)).where("rank <= 7").collect()}
    assert got == exp


def test_append_log_partitioned_and_fetch_retries(spark, tmp_path):
    from webtables.operators.requests import append_log

    log = spark.createDataFrame(
        [(1, T0, True, 3, "fetch"), (2, T0 + dt.timedelta(days=1), True, 3, "served"), (3, T0, False, 1, "fetch")],
        "request_id long, ts timestamp_ntz, success boolean, attempts int, label string",
    )
    path = str(tmp_path / "log")
    append_log(log, path)
    append_log(log, path)
    back = spark.read.parquet(path)
    assert back.count() == 6
    day = back.where(F.col("date") == F.lit("2024-01-02").cast("date"))
    assert day.count() == 2
    assert counters(log).first().total_retries == 4
    assert counters(log, retries_of_fetches_only=True).first().total_retries == 2
