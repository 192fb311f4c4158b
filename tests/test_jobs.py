"""Chat, audits, streams, the parser property and the driver contract."""

import re
from html import unescape

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_prompt_extraction(spark):
    from webtables.operators.chat import last_user_message, prompt_preview

    msgs = spark.createDataFrame(
        [(1, 0, "system", "be brief"), (1, 1, "user", "first"), (1, 2, "assistant", "ok"),
         (1, 3, "user", "  second \n\t prompt  here  "), (2, 0, "system", "x"),
         (3, 0, "user", "w " * 60)],
        "conv_id long, turn long, role string, text string",
    )
    pv = {r.conv_id: r.prompt for r in prompt_preview(msgs).collect()}
    assert pv[1] == "second prompt here" and pv[2] == "(no prompt)"
    assert len(pv[3]) == 80 and pv[3].endswith("...")
    full = {r.conv_id: r.prompt for r in last_user_message(msgs).collect()}
    assert full[1].startswith("  second") and full[2] == ""


def test_token_usage_nulls(spark):
    from webtables.operators.chat import token_usage

    a = spark.createDataFrame(
        [({"prompt_tokens": 10, "completion_tokens": 20, "total_tokens": 30},), ({"prompt_tokens": 1},), (None,)],
        "usage map<string,int>",
    )
    r = token_usage(a).first()
    assert (r.answers, r.prompt_tokens, r.completion_tokens, r.total_tokens) == (3, 11, 20, 30)


def test_outcome_classes(spark):
    from webtables.operators.chat import classify_answers

    log = spark.createDataFrame(
        [("Rate limit exceeded: slow down",), ("Bad request: x",), ("API error: y",),
         ("Perplexity service not available",), (None,)], "error string")
    got = [(r.status_class, r.rate_limited) for r in classify_answers(log).collect()]
    assert got == [(429, True), (400, False), (500, False), (503, False), (200, False)]


def test_audits_on_fixtures(parsed):
    from webtables.operators.audits import accessibility_check, metadata_check, seo_audit

    seo = {r.page_id: (r.title_present, r.description_present, r.single_h1, r.image_alt, r.https) for r in seo_audit(parsed).collect()}
    assert seo[0] == (True, True, False, True, True) and seo[1][0] is False and seo[2] == (False, False, True, False, True)
    a11y = {r.page_id: (r.images_without_alt, r.inputs_without_label, r.heading_skips, r.has_nav, r.has_main) for r in accessibility_check(parsed).collect()}
    assert a11y == {0: (0, 0, 0, False, False), 1: (0, 2, 0, True, True), 2: (1, 0, 1, False, False), 3: (0, 0, 0, False, False)}
    meta = {r.page_id: (r.title, r.description, r.open_graph) for r in metadata_check(parsed).collect()}
    assert meta == {0: (True, True, True), 1: (False, False, False), 2: (False, False, False), 3: (False, False, False)}


def test_host_rule_join_and_merge(spark):
    from webtables.operators.audits import match_host_rules, merge_lists

    df = spark.createDataFrame([(1, "https://a.example.org/x"), (2, "https://example.net/"), (3, "https://b.com/")],
                               "id long, url string")
    rules = spark.createDataFrame([(".example.org",), ("example.net",), ("",)], "rule string")
    got = sorted((r.id, r.rule) for r in match_host_rules(df, rules).collect())
    assert got == [(1, ".example.org"), (2, "example.net")]
    a = spark.createDataFrame([("x",), ("y",)], "h string")
    b = spark.createDataFrame([("y",), ("z",)], "h string")
    assert sorted(r.h for r in merge_lists(a, b, "h").collect()) == ["x", "y", "z"]


def test_parse_keeps_all_text(spark):
    """Property: on well-formed pages the text nodes, concatenated, equal the
    tag-free source (script/style bodies and comments removed)."""
    from webtables.operators.parse import parse_pages
    from webtables.sources.tables import pages

    p = parse_pages(pages(spark, SF))
    rows = p.select(
        "html", F.array_join(F.transform(F.filter("nodes", lambda n: n["kind"] == "text"), lambda n: n["text"]), "").alias("t")
    ).collect()
    for r in rows:
        src = re.sub(r"<script.*?</script>|<style.*?</style>|<!--.*?-->|<![^>]*>", "", r.html, flags=re.S)
        assert unescape(re.sub(r"<[^>]*>", "", src)) == r.t


def test_streams_match_batch(spark):
    from webtables.operators.freshness import label_fetches
    from webtables.sources.derived import request_log
    from webtables.streaming import jobs as S

    batch = {r.request_id: r.label for r in label_fetches(request_log(spark, SF)).collect()}
    stream = {r.request_id: r.label for r in S.ttl_dedup_stream(spark, SF).collect()}
    assert stream == batch
    top = S.last_n_stream(spark, SF, 10).orderBy(F.col("ts").desc()).collect()
    assert len(top) == 10
    c = {r.request_type: r.total for r in S.running_counters(spark, SF).collect()}
    assert sum(c.values()) == 1000


def test_ttl_stream_takes_rows_out_of_order(spark, tmp_path):
    """Rows up to a day out of order, over several files and two runs, get the labels that
    the batch fold gives them."""
    from webtables.operators.freshness import label_fetches
    from webtables.sources.derived import request_log, request_log_from_events
    from webtables.streaming import jobs as S

    ev = spark.read.parquet(f"{SF}/events.parquet")
    rows = sorted(ev.collect(), key=lambda r: (r.ts.timestamp() + (hash(r.event_id * 7919) % 80_000), r.event_id))
    assert [r.event_id for r in rows] != [r.event_id for r in sorted(rows, key=lambda r: r.ts)]
    src, work = tmp_path / "in", str(tmp_path / "work")
    src.mkdir()
    step = len(rows) // 5 + 1

    def add(k):
        import pyarrow as pa
        import pyarrow.parquet as pq

        part = rows[k * step : (k + 1) * step]
        name = "events.parquet" if k == 0 else f"events-{k}.parquet"
        pq.write_table(spark.createDataFrame(part, ev.schema).toArrow().cast(pa.schema(spark.read.parquet(f"{SF}/events.parquet").limit(1).toArrow().schema)), str(src / name))

    for k in range(3):
        add(k)
    some = S.ttl_dedup_stream(spark, str(src), work=work, max_files=1).collect()
    for k in range(3, 5):
        add(k)
    done = S.ttl_dedup_stream(spark, str(src), work=work, max_files=1, close=True).collect()
    want = {(r.request_id, r.label, r.fetched_at) for r in label_fetches(request_log(spark, SF)).collect()}
    assert 0 < len(some) < len(done) and len(done) == len(rows)
    assert {(r.request_id, r.label, r.fetched_at) for r in done} == want
    assert request_log_from_events(ev).count() == len(rows)


def test_ttl_state_holds_many_keys():
    """One state serves a group of keys: calls grow with the batches, not the keys; labels
    are those of each key's fold, and state and timers end."""
    import random

    import numpy as np
    import pandas as pd

    from webtables.streaming.jobs import TtlDedup, fold_times

    class Held:
        rows, calls = [], 0

        def exists(self):
            return bool(self.rows)

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows, self.calls = list(rows), self.calls + 1

        def appendList(self, rows):
            self.put([*self.rows, *rows])

        def clear(self):
            self.rows = []

    class Handle:
        def __init__(self):
            self.states, self.timers = {}, []

        def getListState(self, name, schema):
            return self.states.setdefault(name, Held())

        def listTimers(self):
            return iter(list(self.timers))

        def registerTimer(self, at):
            self.timers.append(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    class Times:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    rng, second = random.Random(3), 1_000_000
    keys = [None, "", *[f"k{i}" for i in range(300)]]
    rows = [(rng.choice(keys), i, rng.random() < 0.7, rng.randrange(100_000) * second, 3600 * second) for i in range(6000)]
    handle, work, got = Handle(), TtlDedup(), []
    work.init(handle)
    for mark in (0, 30_000, 60_000, 200_000):  # rows come when their time is near the watermark
        part = [r for r in rows if r[3] < (mark + 30_000) * second and r[3] >= (mark if mark else 0) * second] if mark < 200_000 else []
        if mark == 60_000:
            part += [r for r in rows if r[3] >= 90_000 * second]
        pdf = pd.DataFrame([*part, (None, None, False, 0, 0)], columns=["cache_key", "request_id", "success", "ts_us", "ttl_us"])
        if mark:
            got += [tuple(r) for out in work.handleExpiredTimer((7,), Times(mark * 1000), None) for r in out.itertuples(index=False)]
        list(work.handleInputRows((7,), iter([pdf[:2500], pdf[2500:]]), Times(mark * 1000)))
        assert len(handle.timers) == (mark < 200_000)
    want = set()
    for k in keys:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[3], r[1]))
        ids, ok, ts, ttl = (np.array(c) for c in zip(*[r[1:] for r in mine], strict=True))
        served, fetched, has, _ = fold_times(ts, ok, ttl, None)
        want |= {(i, k, "served" if s else "fetch", int(f) if h else None) for i, s, f, h in zip(ids.tolist(), served, fetched, has, strict=True)}
    assert len(got) == len(rows) and {(i, k, x, None if pd.isna(f) else int(f)) for i, k, x, f in got} == want
    assert not any(st.rows for st in handle.states.values()) and sum(st.calls for st in handle.states.values()) < 12


def test_streams_read_tables_in_folders(spark, tmp_path):
    """A table may be one file or a folder of part files, and a later run with the same
    work folder reads the parts and files that came since."""
    import shutil

    from webtables.streaming import jobs as S

    src, work = tmp_path / "in", str(tmp_path / "work")
    pages = spark.createDataFrame([(k, f"https://a.example/{k}", f"<p>w{k}</p><a href='/x'>y</a>") for k in range(7)], "page_id long, url string, html string")
    pages.where("page_id < 4").repartition(2).write.parquet(str(src / "pages.parquet"))
    got = S.page_conversion_stream(spark, str(src), work=work).collect()
    assert sorted((r.page_id, r.text, r.links) for r in got) == [(k, f"w{k}\ny", 1) for k in range(4)]
    pages.where("page_id = 4").coalesce(1).write.mode("append").parquet(str(src / "pages.parquet"))
    pages.where("page_id > 4").coalesce(1).write.parquet(str(tmp_path / "late"))
    shutil.copy(next((tmp_path / "late").glob("*.parquet")), src / "pages-1.parquet")
    got = S.page_conversion_stream(spark, str(src), work=work).collect()
    assert sorted(r.page_id for r in got) == list(range(7))
    ev = spark.read.parquet(f"{SF}/events.parquet")
    ev.repartition(3).write.parquet(str(src / "events.parquet"))
    assert sum(r.total for r in S.running_counters(spark, str(src)).collect()) == ev.count()


def test_newest_requests_over_several_runs(spark, tmp_path):
    """Files in any order and two runs give the newest rows of all."""
    import shutil

    from webtables.sources.derived import request_log_from_events
    from webtables.streaming import jobs as S

    ev = spark.read.parquet(f"{SF}/events.parquet")
    src, work = tmp_path / "in", str(tmp_path / "work")
    src.mkdir()
    shutil.copy(f"{SF}/events.parquet", src / "events.parquet")
    want = [r.request_id for r in request_log_from_events(ev).orderBy(F.desc("ts"), F.desc("request_id")).limit(40).collect()]
    assert [r.request_id for r in S.last_n_stream(spark, str(src), 40, work=work).collect()] == want
    late = ev.where("event_id < 30").withColumn("event_id", F.col("event_id") + 100_000).withColumn("ts", F.expr("ts + INTERVAL 1 YEAR"))
    late.coalesce(1).write.parquet(str(tmp_path / "late"))
    shutil.copy(next((tmp_path / "late").glob("*.parquet")), src / "events-1.parquet")
    got = S.last_n_stream(spark, str(src), 40, work=work).collect()
    assert [r.request_id for r in got] == [100_000 + r.event_id for r in ev.where("event_id < 30").orderBy(F.desc("ts"), F.desc("event_id")).collect()] + want[:10]


def test_linked_domains_count_own_links(spark, tmp_path):
    """Every linked host, a page's own one too, with what comes from other hosts beside."""
    import __spark_entry__ as E

    pages = spark.createDataFrame([(k, f"https://{'a' if k < 2 else 'b'}.example/{k}", '<a href="/x">x</a><a href="/y">y</a>') for k in range(3)], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    crawl = {tuple(r) for r in E.queries()["a15_linked_domains_crawl"](spark, str(tmp_path)).collect()}
    assert crawl == {("a.example", 4, 2, 0, 0), ("b.example", 2, 1, 0, 0)}
    # 1 -> 10 % 3 = 1 and 2 -> 17 % 3 = 2, each its own host; 0 -> a gone page
    graph = {tuple(r) for r in E.queries()["a15_linked_domains"](spark, str(tmp_path)).collect()}
    assert graph == {("a.example", 1, 1, 0, 0), ("b.example", 1, 1, 0, 0), ("gone.example.com", 1, 1, 1, 1)}


def test_similar_pages_equal_brute_force(spark):
    """Links of classes with a similarity of 0.5 or more within a host; equal pages and an
    empty one beside them."""
    import random

    from webtables.operators.audits import page_features, similar_pages
    from webtables.operators.parse import parse_pages

    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    texts, base = [], rng.sample(words, 30)
    for k in range(60):
        w = list(base) if k % 2 else rng.sample(words, 30)
        for _ in range(k % 13):
            w[rng.randrange(30)] = rng.choice(words)
        texts.append(" ".join(w))
    texts += [texts[3], texts[3], "", ""]
    rows = [(k, f"https://{'a' if k % 3 else 'b'}.example/{k}", f"<p>{t}</p>") for k, t in enumerate(texts)]
    f = page_features(parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))).cache()
    sets = {r.page_id: (r.url[8], frozenset(r.words)) for r in f.collect()}
    classes = {}
    for k in sorted(sets):
        classes.setdefault(sets[k], k)
    want = set()
    for (ga, a), i in classes.items():
        for (gb, b), j in classes.items():
            if ga == gb and i < j and a | b and 2 * len(a & b) >= len(a | b):
                want.add((i, j, len(a & b), int(len(a & b) / len(a | b) * 10_000 + 0.5) / 10_000))
    links, members = similar_pages(f, 0.5, bands=64, rows=2)
    assert {(r.class_a, r.class_b, r.shared, r.jaccard) for r in links.collect()} == want and len(want) > 50
    assert {r.page_id: r.class_id for r in members.collect()} == {k: classes[s] for k, s in sets.items()}
    found = {(r.class_a, r.class_b) for r in similar_pages(f, 0.5)[0].collect()}
    assert len(found) >= 0.95 * len(want) and found <= {w[:2] for w in want}


def test_similar_pages_misses_no_link(spark, monkeypatch):
    """600 pairs at exactly one half, of which MinHash bands missed some; sizes from 2 to 600
    words, a null group, a repeated id and classes in many cells."""
    from webtables.operators import audits

    monkeypatch.setattr(audits, "CELL_CLASSES", 50, raising=False)
    rows, want = [], set()
    for k in range(600):
        same = [f"s{k}x{i}" for i in range(2 * (1 + k % 10))]
        for j in (0, 1):
            rows.append((2 * k + j, "g" if k % 3 else None, same + [f"o{k}x{j}x{i}" for i in range(len(same) // 2)]))
        want.add((2 * k, 2 * k + 1, len(same), 0.5))
    big = [f"b{i}" for i in range(600)]
    rows += [(5000, "g", big), (5001, "g", big[:300]), (5002, "g", big[:299]), (5003, None, big), (5004, "h", []), (5005, "h", None)]
    rows += [(5001, "g", ["again", "and"]), (5006, "g", ["again", "and", "more"])]
    want |= {(5000, 5001, 300, 0.5), (5001, 5002, 299, 0.9967), (5001, 5006, 2, 0.6667)}
    f = spark.createDataFrame([(i, "https://a.example/", g, w) for i, g, w in rows], "page_id long, url string, g string, words array<string>")
    links, _ = audits.similar_pages(f, 0.5, group=F.col("g"))
    assert sorted((r.class_a, r.class_b, r.shared, r.jaccard) for r in links.collect()) == sorted(want)


def test_similar_pages_of_a_large_group(spark):
    """100,000 pages of one host, a third of them alike: candidates stay few."""
    from webtables.operators.audits import similar_pages

    n = 100_000
    word = lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64(F.when(F.col("page_id") % 3 == 0, F.lit(0)).otherwise(F.col("page_id")), F.lit(k)), F.lit(50_000)).cast("string"))
    f = spark.range(n).withColumnRenamed("id", "page_id").select("page_id", F.lit("https://a.example/").alias("url"), F.array_distinct(F.array(*[word(k) for k in range(12)])).alias("words"))
    links, members = similar_pages(f, 0.5, bands=8)
    assert members.where("page_id <> class_id").count() == (n - 1) // 3 and links.count() == 0


def test_fetch_records(spark, tmp_path):
    """Lines that are no records, absent fields and fields of another kind stay alone."""
    from webtables.operators.pages import batch_convert
    from webtables.sources.fetches import fetched_pages, read_fetches

    lines = ['{"page_id": 1, "url": "https://a.example/", "html": "<p>x", "status_code": 200, "metadata": {"attempts": 3, "headers": {"etag": "e"}, "more": [1, {"deep": 2}]}}',
             "not a record", '{"page_id": 2, "url": "https://b.example/", "error": "Timeout: 3"}',
             '{"page_id": 3, "url": "https://c.example/", "html": "<b>y</b>", "metadata": {"attempts": "many", "final_url": "https://d.example/"}}']
    (tmp_path / "part.json").write_text("\n".join(lines))
    assert read_fetches(spark, str(tmp_path)).schema["metadata"].dataType.simpleString() == "variant"
    got = {r.page_id: r for r in batch_convert(fetched_pages(spark, str(tmp_path)), "text", include_headers=True).collect()}
    assert (got[1].content, got[1].metadata.attempts, got[1].metadata.headers, got[1].status_code) == ("x", 3, {"etag": "e"}, 200)
    assert (got[2].success, got[2].error) == (False, "Timeout: 3")
    assert (got[3].content, got[3].metadata.attempts, got[3].final_url) == ("y", None, "https://d.example/")
    assert got[None].error.startswith("ValueError: ") and not got[None].success


def test_a_list_of_urls(spark):
    from webtables.operators.audits import compare_list, compare_pairs

    rows = [(1, "https://a.example/", "<h1>Tea</h1><p>green tea <a href='/x'>leaf</a></p>"), (2, "https://b.example/", "<h1>Tea</h1><p>black tea</p>"),
            (3, "https://a.example/", "<p>mint</p>"), (4, "https://c.example/", ""), (5, "https://d.example/", "<p>green</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    urls = ["https://b.example/", "https://a.example/", "https://b.example/", "https://gone.example/", "https://c.example/"]
    got = {(r.kind, r.item): (r.pages, r.on_all) for r in compare_list(pages, urls).collect()}
    assert got == {("word", "tea"): ([0, 1], False), ("word", "green"): ([1], False), ("word", "leaf"): ([1], False), ("word", "black"): ([0], False),
                   ("word", "mint"): ([1], False), ("link", "https://a.example/x"): ([1], False), ("heading", "Tea"): ([0, 1], False)}
    assert {(r.kind, r.item) for r in compare_list(pages, urls[:2]).where("on_all").collect()} == {("word", "tea"), ("heading", "Tea")}
    pairs = {(r.kind, r.a, r.b): (r.shared, r.only_a, r.only_b, r.jaccard) for r in compare_pairs(pages, urls).collect()}
    assert pairs[("word", 0, 1)] == (1, 1, 3, 0.2) and pairs[("heading", 0, 1)] == (1, 0, 0, 1.0) and pairs[("link", 0, 1)] == (0, 0, 1, 0.0)
    assert pairs[("word", 0, 3)] == (0, 2, 0, 0.0) and pairs[("link", 0, 3)] == (0, 0, 0, 1.0) and len(pairs) == 9


def test_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert set(df.columns) == {"host", "pages", "links"} and df.count() > 0
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 75


def test_error_isolation_and_totals(spark):
    from webtables.operators.pages import batch_convert, batch_totals

    rows = [(0, "https://ok.example/a", "<title>A</title><p>x</p>"), (1, "ftp://bad.example/b", "<p>y</p>"),
            (2, "https://ok.example/c", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r for r in batch_convert(df, "text").collect()}
    assert out[0].success and out[0].content == "A\nx" and out[0].error is None
    assert not out[1].success and out[1].error.startswith("ValueError: No provider supports URL")
    assert not out[2].success and out[2].error.startswith("ValueError")
    t = batch_totals(batch_convert(df, "text")).first()
    assert (t.total, t.successful, t.failed) == (3, 1, 2)
    empty = batch_totals(batch_convert(df.limit(0), "text")).first()
    assert (empty.total, empty.successful, empty.failed) == (0, 0, 0)


def test_url_list_and_helpers(spark):
    from webtables.functions.text import comma_list
    from webtables.sources.tables import url_list

    assert url_list(spark, []).count() == 0
    assert [(r.pos, r.url) for r in url_list(spark, ["b", "a", "b"]).collect()] == [(0, "b"), (1, "a"), (2, "b")]
    r = spark.createDataFrame([(" a, b ,c ,, ",)], "s string").select(comma_list("s").alias("x")).first()
    assert r.x == ["a", "b", "c", "", ""]
    m = spark.createDataFrame([({"a": "1", "title": "x"},)], "m map<string,string>").select(
        F.map_concat("m", F.create_map(F.lit("title"), F.lit("y"))).alias("m")).first().m
    assert m == {"a": "1", "title": "y"}  # right wins (LAST_WIN)


def test_parse_with_store_reuses(spark, tmp_path):
    from webtables.operators.content import page_text
    from webtables.operators.parse import parse_with_store
    from webtables.sources.tables import pages

    path = str(tmp_path / "nodes")
    p = pages(spark, SF)
    first = parse_with_store(p, path).select("page_id", page_text("nodes").alias("t"))
    assert first.count() == 50
    assert spark.read.parquet(path).count() == 50
    again = parse_with_store(p, path)
    assert again.count() == 50 and spark.read.parquet(path).count() == 50  # nothing re-parsed


def test_windowed_stream_stats(spark):
    from webtables.streaming import jobs as S

    tumbling = {r.window_start: r.total for r in S.windowed_stats(spark, SF, "1 day").collect()}
    assert sum(tumbling.values()) == 1000
    sliding = S.windowed_stats(spark, SF, "2 days", slide="1 day").agg(F.sum("total")).first()[0]
    assert sliding == 2000  # every event falls in exactly two windows
    closed = {r.window_start: r.total for r in S.windowed_stats(spark, SF, "1 day", mode="append").collect()}
    assert 0 < len(closed) < len(tumbling)  # append emits closed windows only
    assert all(tumbling[k] == v for k, v in closed.items())


def test_parse_with_store_dedupes_identical_pages(spark, tmp_path):
    from webtables.operators.content import page_text
    from webtables.operators.parse import parse_with_store

    rows = [(1, "https://a.example/x", "<p>same</p>"), (2, "https://b.example/y", "<p>same</p>"),
            (3, "https://c.example/z", "<p>other</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "nodes")
    out = {r.page_id: r.t for r in parse_with_store(df, path).select("page_id", page_text("nodes").alias("t")).collect()}
    assert out == {1: "same", 2: "same", 3: "other"}
    assert spark.read.parquet(path).count() == 2  # identical content parsed once


def test_fresh_copy_open_interval_and_many_ttls(spark):
    """A null TTL never expires; the newest copy alive at the request's time answers."""
    from webtables.operators.freshness import fresh_copy

    at = lambda s: f"2024-01-01 {s}"
    store = spark.createDataFrame(
        [("a", at("00:00:00"), None, "old"), ("a", at("01:00:00"), 60, "short"), ("a", at("01:00:30"), 86400, "day"), ("b", at("00:00:00"), 1, "blink"), ("c", at("00:00:00"), 0, "never")],
        "cache_key string, fetched_at string, ttl_s int, content string",
    ).withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    asked = [(1, "a", at("00:00:00")), (2, "a", "2023-12-31 23:59:59"), (3, "a", at("01:00:10")), (4, "a", at("01:00:30")), (5, "a", "2024-01-03 00:00:00"),
             (6, "b", at("00:00:00.999999")), (7, "b", at("00:00:01")), (8, "c", at("00:00:00")), (9, "z", at("00:00:00"))]
    req = spark.createDataFrame(asked, "request_id long, cache_key string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.request_id: r.content for r in fresh_copy(req, store, content=True).collect()}
    assert got == {1: "old", 2: None, 3: "short", 4: "day", 5: "old", 6: "blink", 7: None, 8: None, 9: None}
    plan = fresh_copy(req, store)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [x for x in plan if "content" in x and "LogicalRDD" not in x]  # keys and times only


def test_parse_with_store_keeps_pages_without_content(spark, tmp_path):
    from webtables.operators.parse import parse_with_store

    df = spark.createDataFrame([(1, "<p>a</p>"), (2, None)], "page_id long, html string")
    for _ in range(2):
        rows = {r.page_id: r for r in parse_with_store(df, str(tmp_path / "store")).collect()}
        assert set(rows) == {1, 2} and rows[2].nodes is None and "no content" in rows[2].parse_error


def test_streams_resume_in_their_work_folder(spark, tmp_path):
    """Run, let a new file arrive, run again: the state goes on and only the new file is read."""
    import shutil

    from webtables.streaming import jobs

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = tmp_path / "in"
    src.mkdir()
    for k in range(2):
        part = tmp_path / f"part{k}"
        events.where(F.col("event_id") % 2 == k).coalesce(1).write.parquet(str(part))
        shutil.copy(next(part.glob("part-*.parquet")), src / ("events-1.parquet" if k else "events.parquet"))
        total = jobs.running_counters(spark, str(src), work=str(tmp_path / "t1")).agg(F.sum("total")).first()[0]
        kept = {r.request_id for r in jobs.last_n_stream(spark, str(src), 10, work=str(tmp_path / "t4")).collect()}
    assert total == events.count()
    newest = events.orderBy(F.desc("ts"), F.desc("event_id")).limit(10)
    assert kept == {r.event_id for r in newest.collect()}


def test_competitor_sites_and_retried_errors(spark):
    from webtables.operators.retry import is_retried

    errors = ["Timeout: 1", "ConnectionError: x", "HTTPError: 500", "HTTP version", "Connection pool", "ValueError"]
    df = spark.createDataFrame([(e,) for e in errors], "e string")
    assert [r.e for r in df.where(is_retried(F.col("e"))).collect()] == errors[:3]


def test_sql_function_and_markdown_view(spark):
    from urllib.parse import urljoin

    from webtables.plans.sql import register

    register(spark, "/root/testdata/sf0.001")
    cases = [("http://a.example/b/c?x", "../d"), ("http://a.example/b/c", "//h.example/y"), ("https://a.example/", "?q=1"), ("http://a.example/b/", "c/./d/../e#f"), ("http://a.example/x", "mailto:me@x.example")]
    df = spark.createDataFrame(cases, "base string, href string")
    df.createOrReplaceTempView("link_cases")
    got = [tuple(r) for r in spark.sql("SELECT base, href, url_join(base, href) FROM link_cases").collect()]
    assert got == [(b, h, urljoin(b, h)) for b, h in cases]
    assert spark.sql("SELECT count(*) FROM page_markdown WHERE length(markdown) > 0").first()[0] == 50
