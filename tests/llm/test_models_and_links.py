"""Classifiers by held-out accuracy, search by recall, URL rules and components by cases."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from webtables.llm import ann, quality, toxicity, url_filter
from webtables.llm.components import components
from webtables.llm.queries import OP10_SQL, URL_RULES


def corpus(spark, n=1200):
    """Documents of which a tenth hold one of a few words, and another tenth shout."""
    rng = random.Random(2)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    docs, labels = [], []
    for k in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(5, 120))]
        toxic, bad = k % 10 == 0, k % 10 == 1
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["grumph", "Skarn,", "blort"])
        if bad:
            w = [x.upper() + "!!" for x in w]
        docs.append((k, " ".join(w), rng.choice(["en", "de", None]), f"src{k % 7}", None))
        labels.append((k, int(not bad), int(toxic)))
    docs += [(None, "grumph of no id", "en", None, None), (n, None, None, None, None), (n + 1, "", None, None, None), (n + 2, "lorem " * 50_000 + "blort", "en", "x", None), (0, docs[0][1], "en", "src0", None)]
    labels += [(None, 1, 1), (5, None, None), (0, 1, 1), (10**9, 1, 1)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, id string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def accuracy(rows, truth):
    held = [(r, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    return len(held), sum(r.predicted == y for r, y in held) / len(held)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    n, right = accuracy(rows, {k: int(k % 10 == 0) for k in range(1200)})
    assert n > 200 and right > 0.98
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1202].predicted == 1  # a word at the end of 50,000
    assert by[1200].score == by[1201].score and by[1200].predicted == 0


def test_toxicity_without_labels_or_rows(spark):
    docs, labels = corpus(spark, 20)
    assert {r.predicted for r in toxicity.toxicity(docs, labels.where("toxic = 0")).collect()} == {0}
    assert len({r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()}) == 1
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


def test_ftrl_weights_are_sparse():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(10, 4000, 60)).astype(np.int32) for _ in range(800)]
    y = np.arange(800) % 5 == 0
    rows = [np.unique(np.r_[f, 3]).astype(np.int32) if t else f for f, t in zip(rows, y, strict=True)]
    m = toxicity.fit_ftrl(rows, y.astype(float), bits=12)
    weight = dict(zip(m.features.tolist(), m.weights.tolist(), strict=True))
    assert len(weight) < 200 and weight[3] == max(weight.values())


def test_quality_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    model = quality.train(docs, labels, labelled=400, unlabelled=300)
    assert len(model.rounds) == quality.ROUNDS and model.rounds[-1][0] > 0 and model.rounds[-1][1] > 0
    rows = quality.score(docs, model).withColumn("held_out", toxicity.held_out(F.col("doc_id"))).withColumn("predicted", F.col("kept").cast("int")).collect()
    n, right = accuracy(rows, {k: int(k % 10 != 1) for k in range(1200)})
    assert n > 200 and right > 0.97
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == docs.count()
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id % 10 = 1 AND doc_id < 1200").count() < 10


def test_quality_without_labels_keeps_all(spark):
    docs, labels = corpus(spark, 20)
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.count()
    assert quality.keep_good(docs.drop("lang", "source"), labels.where("quality = 1")).count() == docs.count()
    assert quality.quality(docs.limit(0), labels).collect() == []


def test_views_disagree_before_and_teach_each_other():
    """A free row's label comes from the other view; labelled rows stay as they are."""
    rng = np.random.default_rng(1)
    y = (np.arange(400) % 2).astype(np.float32)
    text = rng.normal(0, 1, (400, 5)).astype(np.float32)
    meta = rng.normal(0, 1, (400, 3)).astype(np.float32)
    text[:, 0] += 4 * y
    meta[:, 0] += 3 * y
    free_y = np.arange(300) % 2
    free_text, free_meta = rng.normal(0, 1, (300, 5)).astype(np.float32), rng.normal(0, 1, (300, 3)).astype(np.float32)
    free_text[:, 0] += 4 * free_y
    free_meta[:, 0] += 3 * free_y
    m = quality.cotrain(text[:60], meta[:60], y[:60], free_text, free_meta, rounds=3)
    z = quality.logit(free_text, m.text) * m.both[0] + quality.logit(free_meta, m.meta) * m.both[1] + m.both[2]
    assert ((z > 0) == free_y).mean() > 0.95 and m.rounds == sorted(m.rounds)


def vectors(spark, n=3000, d=24, hot=900):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (n, d)) * rng.uniform(0.2, 3, (n, 1))
    x[n - hot :] = x[n - 1]  # one vector on many rows
    rows = [(k, [float(v) for v in r], None) for k, r in enumerate(x)]
    rows += [(n, None, None), (n + 1, [0.0] * d, None), (n + 2, [float("nan")] * d, None), (n + 3, [None] + [1.0] * (d - 1), None), (n + 4, [1.0], None), (None, [1.0] * d, None), (n + 5, [float("inf")] * d, None)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>, list int")


def test_search_recall_and_scores(spark):
    x, df = vectors(spark)
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0"), k=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    asked = [k for k in range(len(x)) if k % 20 == 0]
    assert sorted(got) == asked
    found = 0
    for q in asked:
        s = x @ x[q]
        best = [k for k in np.lexsort((np.arange(len(x)), -s)).tolist() if k != q][:20]
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, 21)) and q not in {r[1] for r in rows}
        assert [r[1:] for r in rows] == sorted([r[1:] for r in rows], key=lambda r: (-r[1], r[0]))
        assert np.allclose([r[2] for r in rows], s[[r[1] for r in rows]], rtol=1e-12)
        found += len({r[1] for r in rows} & set(best))
    assert found / (20 * len(asked)) >= 0.9


def test_search_small_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.0]), (3, [0.5, 0.0]), (3, [0.5, 0.0])], "vec_id long, embedding array<double>")
    rows = ann.search(df, df.where("vec_id = 1"), k=20).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in rows] == [(2, 0.5), (3, 0.5), (3, 0.5)]
    twice = ann.search(df, df.where("vec_id <= 2").union(df.where("vec_id = 1")), k=2)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in twice.collect()) == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3)]
    assert ann.search(df.limit(0), df).collect() == [] and ann.search(df, df.limit(0)).collect() == []


def test_scan_drops_far_rows_and_keeps_near_ones():
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(0, 0.1, (50, 64)), rng.normal(3, 0.1, (5000, 64))][rng.permutation(5050)]
    q = np.r_[np.zeros((1, 64)), np.full((1, 64), 3.0)]
    d = ((x[None] - q[:, None]) ** 2).sum(2)
    bound = np.sort(d, axis=1)[:, 19]
    asked, rows = ann.scan(x, q, bound)
    for k in (0, 1):
        left = rows[asked == k]
        assert set(np.argsort(d[k])[:20].tolist()) <= set(left.tolist()) and (d[k][left] <= bound[k] * 1.01).all()
    assert (asked == 0).sum() == 20


def test_scan_abandons_most_pairs_of_even_vectors_and_loses_few():
    """Vectors that fill all dimensions: what a pair within the bound shows of its distance
    in the first columns is beta distributed."""
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((4000, 65)) / 65**0.5, rng.standard_normal((60, 65)) / 65**0.5
    d = ((x[None] - q[:, None]) ** 2).sum(2)
    near = np.argsort(d, axis=1)[:, :20]
    bound = np.sort(d, axis=1)[:, 60]
    asked, rows = ann.scan(x, q, bound)
    left = [set(rows[asked == k].tolist()) for k in range(60)]
    assert np.mean([len(set(n.tolist()) & s) / 20 for n, s in zip(near, left, strict=True)]) >= 0.98
    assert all((d[k][list(s)] <= bound[k] * 1.001).all() for k, s in enumerate(left))
    shares = [ann.share(at, 65, 3.0) for at in (16, 32, 48, 65)]
    assert shares == sorted(shares) and shares[0] < 0.5 < shares[1] < 1 and shares[-1] == 1


PAGES = [
    (1, "http://a.example.com/x", "<link rel='canonical' href='http://b.bad.net/'>"),
    (2, "http://b.bad.net/", ""),
    (3, "http://c.example.com/x", '<LINK href=http://d.org/fr/1 REL=canonical><link rel="canonical" href="http://b.bad.net/">'),
    (4, "http://e.example.com/y#part", "<meta http-equiv=refresh content='0; url=/z'>"),
    (5, "http://E.example.com/z", '<link rel="stylesheet" href="http://b.bad.net/">'),
    (6, "HTTP://WWW.Example.NET/en/?q", '<link rel="canonical" href="http://b.bad.net/">'),
    (7, "http://net", ""), (8, "https://net/", ""), (9, None, "<link rel=canonical href='http://b.bad.net/'>"), (10, "no scheme/", ""),
    (11, "http://x.example.com/de/a#f", None), (12, "http://x.example.com/de", ""), (13, "http://notexample.net.org/", ""), (14, "http://h.example.com?x://net/", ""),
    (15, "http://both.example.com/", '<link rel=canonical href="http://d.org/fr/1">'), (16, "http://f.example.com/", "<link rel=canonical href='http://both2.example.com/'>"),
    (None, "http://k.net/", ""), (2, "http://b.bad.net/", ""),
]
WANT = {
    1: ("a.example.com", "/x", None, "allow"), 2: ("b.bad.net", "/", "net/", "block"), 3: ("c.example.com", "/x", None, "allow"),
    4: ("e.example.com", "/y", None, "allow"), 5: ("e.example.com", "/z", None, "allow"), 6: ("www.example.net", "/en/", "example.net/en/", "allow"),
    7: ("net", "", None, "allow"), 8: ("net", "/", "net/", "block"), 9: ("", "", None, "allow"), 10: ("", "", None, "allow"),
    11: ("x.example.com", "/de/a", "example.com/de/", "block"), 12: ("x.example.com", "/de", None, "allow"), 13: ("notexample.net.org", "/", None, "allow"),
    14: ("h.example.com", "", None, "allow"), 15: ("both.example.com", "/", None, "allow"), 16: ("f.example.com", "/", None, "allow"), None: ("k.net", "/", "net/", "block"),
}


def test_url_rules_and_aliases(spark):
    pages = spark.createDataFrame([(i, u, h, None) for i, u, h in PAGES if i != 6], "page_id long, url string, html string, host string")
    got = url_filter.judge_urls(pages, URL_RULES).collect()
    assert len(got) == len(PAGES) - 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == WANT[r.page_id], r
    assert url_filter.judge_urls(pages.limit(0), URL_RULES).collect() == []


def test_every_canonical_and_refresh_target_is_an_alias(spark):
    """A second canonical link counts, and one without a target hides no other."""
    pages = spark.createDataFrame([
        (1, "http://a.example.com/", "<link rel=canonical><link rel=canonical href='http://x.example.com/'><link rel=canonical href='http://k.net/'>"),
        (2, "http://b.example.com/", "<meta http-equiv=refresh content=5><meta http-equiv=refresh content='0; url=http://l.net/'>"),
        (3, "http://c.example.com/", "<link rel=canonical href=''>"), (4, "http://x.example.com/", None),
    ], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(pages, URL_RULES).collect()} == {1: "block", 2: "block", 3: "allow", 4: "block"}
    con = duckdb.connect()
    con.register("pages", pages.toArrow())
    assert {r[0]: r[4] for r in con.execute(OP10_SQL).fetchall()} == {1: "block", 2: "block", 3: "allow", 4: "block"}


def test_explicit_allow_takes_precedence_over_a_block_among_aliases(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(pages, URL_RULES).collect()}
    assert got[6] == "allow" and got[2] == "block"  # their own rules
    assert got[1] == "allow"  # no rule, blocked and allowed aliases
    hops = spark.createDataFrame([("http://f.example.com/", "http://g.example.com/"), ("http://g.example.com/", "http://k.net/"), (None, "http://k.net/")], "a string, b string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(pages, URL_RULES, redirects=hops).collect()}
    assert got[16] == "block"
    assert url_filter.judge_urls(pages, []).where("verdict = 'block'").count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 999), (999, 1000), (5, 5), (None, 3), (3, None)] + [(5000, 5000 + k) for k in range(1, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 0 for k in range(201)} | {999: 999, 1000: 999} | {5000 + k: 5000 for k in range(300)}
    assert got == want
    assert components(spark.createDataFrame([], "a string, b string")).collect() == []
