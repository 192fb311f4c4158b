"""URL and key functions against the Python standard library."""

import hashlib
import itertools
import json
from urllib.parse import urlencode, urljoin

from pyspark.sql import functions as F

from webtables.functions.urls import cache_key, host_matches_rules, is_http_url, query_url, resolve_url, ttl_for_url


def col_values(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_scheme_filter(spark):
    ok = ["http://example.com", "https://example.com", "https://example.com/path?q=1"]
    bad = ["ftp://example.com", "file:///etc/passwd", "javascript:alert(1)", "data:text/html,x",
           "not a url", "", "://invalid", None]
    got = col_values(spark, [(u,) for u in ok + bad], "u string", is_http_url("u"))
    assert got == [True] * len(ok) + [False] * len(bad)


def test_ttl_classes(spark):
    urls = ["https://cdn.example.com/a.js", "https://static.example.com/x.css", "https://api.example.com/v1",
            "https://example.com/realtime", "https://example.com/api/live", "https://example.com/page"]
    got = col_values(spark, [(u,) for u in urls], "u string", ttl_for_url("u"))
    assert got == [86400, 86400, 300, 300, 300, 3600]


def test_cache_key_matches_json_dumps(spark):
    urls = ["https://example.com", "https://example.com/other", "https://ex.com/ü?q=\"x\"", "https://a.com/😀"]
    got = col_values(spark, [(u,) for u in urls], "u string", cache_key(F.col("u"), headers={"User-Agent": "x"}))
    exp = [hashlib.sha256(json.dumps({"url": u, "headers": {"User-Agent": "x"}}, sort_keys=True).encode()).hexdigest()
           for u in urls]
    assert got == exp
    assert len(set(got)) == len(urls)


def test_host_rules(spark):
    hosts = ["test.local", "local", "a.example.org", "example.org", "example.net", "x.example.net", "other.com"]
    got = col_values(spark, [(h,) for h in hosts], "h string", host_matches_rules(F.col("h"), ".local, example.net,  example.org"))
    assert got == [True, False, True, True, True, True, False]
    assert col_values(spark, [("a.com",)], "h string", host_matches_rules(F.col("h"), "")) == [False]


def test_query_url_like_urlencode(spark):
    params = {"api_key": "k~*", "url": "https://a.com/x?y=1&z=2 3", "render_js": None, "country": "us"}
    got = col_values(spark, [(1,)], "i int", query_url("https://proxy.example/v1/", params))[0]
    exp = "https://proxy.example/v1/?" + urlencode({k: v for k, v in params.items() if v is not None})
    assert got == exp


SEGS = ["a", "b", "..", ".", "", "x.html", "%20"]
HREFS = sorted(
    {"/".join(p) for p in itertools.product(SEGS, repeat=2)}
    | {"/" + "/".join(p) for p in itertools.product(SEGS, repeat=2)}
    | {"?q=1", "#frag", "//other.org/p", "mailto:a@b.c", "https://x.org/./y", "", "?", "#", "http:rel",
       "/x?", "/x#", "/x?#", " /lead", "a\tb", "../../../x", "/..", "/.", "..", "."}
)
BASES = ["https://example.com/page/test", "https://example.com", "http://a.b/c/d/?q=1#f",
         "https://h.org/a//b/", "HTTPS://Up.Case/p", "http://a.com:8080/p"]


def test_resolve_url_matches_urljoin(spark):
    pairs = list(itertools.product(BASES, HREFS))
    got = col_values(spark, pairs, "b string, h string", resolve_url("b", "h"))
    bad = [(b, h, g, urljoin(b, h)) for (b, h), g in zip(pairs, got) if g != urljoin(b, h)]
    assert not bad, bad[:5]
