"""Selectors and strips against a plain walk up the tree, on random and very deep pages."""

import random

import pytest
from pyspark.sql import functions as F

from webtables.functions.html import NODE_FIELDS, parse_html
from webtables.operators.content import page_text
from webtables.operators.markdown import nodes_to_markdown, selected_markdown
from webtables.operators.parse import parse_pages, strip_subtrees
from webtables.operators.selectors import match_nodes, selected_subtrees

TAGS = ["div", "p", "a", "nav", "ul", "li", "b", "my-box", "span"]


def random_page(rng):
    out = []
    for _ in range(rng.randrange(5, 60)):
        r = rng.random()
        tag = rng.choice(TAGS)
        if r < 0.5:
            cls = f' class="{rng.choice(["x", "y", "x y", "z"])}"' if rng.random() < 0.5 else ""
            href = f' href="{rng.choice(["/A", "/b", ""])}"' if rng.random() < 0.3 else ""
            out.append(f"<{tag}{cls}{href}>")
        elif r < 0.8:
            out.append(f"</{tag}>")
        elif r < 0.9:
            out.append(rng.choice(["t ", "<!-- c -->", "<br>", "<img src=i>"]))
        else:
            out.append("word")
    return "".join(out)


class Walk:
    """Matching by definition: each step asks every candidate node."""

    def __init__(self, html):
        self.nodes = [dict(zip(NODE_FIELDS, r)) for r in parse_html(html)]
        self.els = [n for n in self.nodes if n["kind"] == "element"]

    def kids(self, n, kind=("element",)):
        return [c for c in self.nodes if c["parent"] == (n["id"] if n else -1) and c["kind"] in kind]

    def sibs(self, n):
        return [c for c in self.els if c["parent"] == n["parent"]]

    def above(self, n):
        while n["parent"] >= 0:
            n = self.nodes[n["parent"]]
            yield n

    def has(self, n, cls):
        return cls in (n["attrs"].get("class") or "").split()

    def all(self, test):
        return [n["id"] for n in self.els if test(n)]


CASES = {
    "div a": lambda w: w.all(lambda n: n["tag"] == "a" and any(m["tag"] == "div" for m in w.above(n))),
    "my-box b": lambda w: w.all(lambda n: n["tag"] == "b" and any(m["tag"] == "my-box" for m in w.above(n))),
    ".x li": lambda w: w.all(lambda n: n["tag"] == "li" and any(w.has(m, "x") for m in w.above(n))),
    "div .x span": lambda w: w.all(lambda n: n["tag"] == "span" and any(w.has(m, "x") and any(k["tag"] == "div" for k in w.above(m)) for m in w.above(n))),
    "ul > li": lambda w: w.all(lambda n: n["tag"] == "li" and n["parent"] >= 0 and w.nodes[n["parent"]]["tag"] == "ul"),
    "div > .x + a": lambda w: w.all(lambda n: n["tag"] == "a" and n["parent"] >= 0 and w.nodes[n["parent"]]["tag"] == "div" and any(
        w.has(s, "x") and s["id"] < n["id"] and not [t for t in w.sibs(n) if s["id"] < t["id"] < n["id"]] for s in w.sibs(n))),
    "p ~ a": lambda w: w.all(lambda n: n["tag"] == "a" and any(s["tag"] == "p" and s["id"] < n["id"] for s in w.sibs(n))),
    ".x ~ .y b, nav a": lambda w: w.all(lambda n: (n["tag"] == "b" and any(w.has(m, "y") and any(w.has(s, "x") and s["id"] < m["id"] for s in w.sibs(m)) for m in w.above(n)))
                                        or (n["tag"] == "a" and any(m["tag"] == "nav" for m in w.above(n)))),
    "b:last-child": lambda w: w.all(lambda n: n["tag"] == "b" and w.sibs(n)[-1] is n),
    ":nth-last-child(2)": lambda w: w.all(lambda n: len(w.sibs(n)) > 1 and w.sibs(n)[-2] is n),
    "a:nth-last-of-type(2n+1)": lambda w: w.all(lambda n: n["tag"] == "a" and [s for s in w.sibs(n) if s["tag"] == "a"][::-1].index(n) % 2 == 0),
    ":only-child": lambda w: w.all(lambda n: len(w.sibs(n)) == 1),
    "p:only-of-type": lambda w: w.all(lambda n: n["tag"] == "p" and sum(s["tag"] == "p" for s in w.sibs(n)) == 1),
    ":empty": lambda w: w.all(lambda n: not w.kids(n, ("element", "text", "raw"))),
    ":is(p, .x)": lambda w: w.all(lambda n: n["tag"] == "p" or w.has(n, "x")),
    "div :not(.x, a)": lambda w: w.all(lambda n: not w.has(n, "x") and n["tag"] != "a" and any(m["tag"] == "div" for m in w.above(n))),
    "a[href='/a' i]": lambda w: w.all(lambda n: n["tag"] == "a" and (n["attrs"].get("href") or "").lower() == "/a"),
    "a[href='/a']": lambda w: [],
    ":root": lambda w: w.all(lambda n: n["parent"] < 0),
}


@pytest.fixture(scope="module")
def random_pages(spark):
    rng = random.Random(8)
    htmls = [random_page(rng) for _ in range(150)] + ["", None, "plain", "<p></p>"]
    return htmls, parse_pages(spark.createDataFrame(list(enumerate(htmls)), "page_id int, html string")).cache()


@pytest.mark.parametrize("selector", list(CASES))
def test_selector_matches_a_walk(random_pages, selector):
    htmls, parsed = random_pages
    got = {r.page_id: r.ids for r in parsed.select("page_id", F.transform(match_nodes("nodes", selector), lambda n: n["id"]).alias("ids")).collect()}
    want = {i: None if h is None else CASES[selector](Walk(h)) for i, h in enumerate(htmls)}
    assert got == want
    assert selector == "a[href='/a']" or any(want.values())


@pytest.mark.parametrize("strip", [["nav"], ["my-box", "ul"], ["br"]])
def test_strip_matches_a_walk(random_pages, strip):
    htmls, parsed = random_pages
    kept = F.transform(strip_subtrees(F.col("nodes"), strip), lambda n: n["id"])
    parts = {s: F.transform(selected_subtrees("nodes", s, strip), lambda n: n["id"]) for s in (".x", "div .x", "nav ~ ul")}
    for r in parsed.select("page_id", kept.alias("ids"), *[c.alias(s) for s, c in parts.items()]).collect():
        if htmls[r.page_id] is None:
            assert r.ids is None
            continue
        w = Walk(htmls[r.page_id])
        gone = lambda n, top: n["tag"] in strip or any(m["tag"] in strip and m["id"] >= top for m in w.above(n))
        assert r.ids == [n["id"] for n in w.nodes if not gone(n, 0)]
        hits = {".x": w.all(lambda n: w.has(n, "x")), "div .x": w.all(lambda n: w.has(n, "x") and any(m["tag"] == "div" for m in w.above(n))),
                "nav ~ ul": w.all(lambda n: n["tag"] == "ul" and any(s["tag"] == "nav" and s["id"] < n["id"] for s in w.sibs(n)))}
        for s, found in hits.items():
            assert r[s] == [n["id"] for e in found for n in w.nodes[e : w.nodes[e]["end_id"] + 1] if not gone(n, e)]


def test_a_hundred_thousand_levels(spark):
    n = 100_000
    html = "<div class=top>" + "<font>" * n + "<p><a href=/x>in</a><nav><b>gone</b></nav><my-box>own</my-box></p>"
    p = parse_pages(spark.createDataFrame([(1, html)], "page_id int, html string"))
    r = p.select(
        *[F.size(match_nodes("nodes", s)).alias(f"c{i}") for i, s in enumerate(["div a", ".top a", "p > a", "font font", ".top > font", "font:only-child"])],
        page_text("nodes", ["nav"]).alias("text"), page_text(F.col("nodes"), ["nav", "my-box"]).alias("less"),
    ).first()
    assert r[:6] == (1, 1, 1, n - 1, 1, n)
    assert r.text == "in\nown" and r.less == "in"
    md = parse_pages(spark.createDataFrame([(1, html)], "page_id int, html string"), markdown_strip=["nav"]).first()
    assert md.parse_error is None and md.markdown == "[in](/x)\n\nown"


def test_what_is_selected_is_a_page_of_its_own(spark):
    """Strips look at ancestors inside a match only, and a nested match comes twice."""
    html = "<nav><div class=m>a<div class=m>b<nav>c</nav></div></div></nav>"
    p = parse_pages(spark.createDataFrame([(1, html), (2, None), (3, "<i class=m>z</i>")], "page_id int, html string"))
    for sel in (".m", ".m, .q .m"):
        got = p.select(page_text(selected_subtrees("nodes", sel, ["nav"]), []).alias("t"), selected_markdown(F.col("nodes"), sel, ["nav"]).alias("md")).collect()
        assert [(r.t, r.md) for r in got] == [("a\nb\nb", "a\n\nb\n\nb"), (None, None), ("z", "*z*")]
    assert p.select(nodes_to_markdown(selected_subtrees("nodes", ".m"), ["nav"])).first()[0] == "a\n\nb\n\nb"
