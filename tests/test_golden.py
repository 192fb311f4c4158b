"""Whole results on our own pages (tests/fixtures.py), worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tests import fixtures as fx
from webtables.operators.content import page_links, page_metadata, page_text
from webtables.operators.markdown import nodes_to_markdown
from webtables.operators.selectors import filter_by_selector, selected_subtrees

SHOP, TIMETABLE, RECIPE, BLANK = range(4)


def one(parsed, page_id, col):
    return parsed.where(F.col("page_id") == page_id).select(col.alias("v")).first().v


TEXT = {
    SHOP: ["Seeds & Bulbs, A < B", "Cart", "Call", "Kind", "Price", "Queen of Night", "$1,299.00 a sack", "Apeldoorn", "€5",
           "3 < 4 and 5 > 2,", "sale", "ends 2031-05-17", "or ring +44 (1632) 960-001", "Second", "shop", "next", "door"],
    TIMETABLE: ["One", "Stops", "Two", "Line 2", "Harbour", "Mill", "Depot", "Print", "Desk", "Nowhere", "Stop", "Mon", "Tue"],
    RECIPE: ["Soup", "For six", "Salt late.", "2 leeks", "1 l stock", "or water", "simmer", "20 min", "n*m", "bowls, see", "/soups", "and", "taste", "_often_"],
    BLANK: [],
}


@pytest.mark.parametrize("page", TEXT)
def test_text(parsed, page):
    """A stray ``<`` does not part a line; scripts, styles and noscript are no text."""
    assert one(parsed, page, page_text("nodes")).split("\n") == (TEXT[page] or [""])


def test_text_strip_list(parsed):
    assert one(parsed, TIMETABLE, page_text("nodes", ["nav", "main", "form"])) == "Scripts are off"
    assert one(parsed, TIMETABLE, page_text("nodes", [])).endswith("Tue\nScripts are off")


def test_markdown(parsed):
    assert one(parsed, RECIPE, nodes_to_markdown(F.col("nodes"))) == (
        "# Soup\n\n### For six\n\n> Salt late.\n\n* 2 leeks\n* 1 l stock\n    + or water\n\n```\nsimmer\n  20 min\n```\n\n---\n\n"
        " ![A pot](pot.png)![](spoon.png)\n\n`n*m` bowls, see </soups> and *taste*\\_often\\_"
    )
    shop = one(parsed, SHOP, nodes_to_markdown(F.col("nodes"), ["head", "table", "div"]))
    assert shop == (
        "3 < 4 and 5 > 2, **sale** ends 2031-05-17  \nor ring +44 (1632) 960-001\n\n"
        'Second [shop *next* door](https://Other.example:8443/Tulips/?x=/#frag "Elsewhere")'
    )
    assert one(parsed, BLANK, nodes_to_markdown(F.col("nodes"))) == ""


LINKS = {
    SHOP: [("/cart", "Cart", ""), ("tel:+441632960000", "Call", ""), ("https://Other.example:8443/Tulips/?x=/#frag", "shopnextdoor", "Elsewhere")],
    TIMETABLE: [("1", "One", ""), ("1/stops", "Stops", ""), ("2", "Two", ""), ("javascript:print()", "Print", ""), ("mailto:desk@bus.example", "Desk", ""), ("", "", "")],
    RECIPE: [("/soups", "/soups", "")],
    BLANK: [],
}


@pytest.mark.parametrize("page", LINKS)
def test_links(parsed, page):
    assert [(x.url, x.text, x.title or "") for x in one(parsed, page, page_links("nodes"))] == LINKS[page]


def test_links_resolved(parsed):
    assert [x.url for x in one(parsed, TIMETABLE, page_links("nodes", F.col("url")))] == [
        "http://bus.example/1", "http://bus.example/1/stops", "http://bus.example/2", "javascript:print()", "mailto:desk@bus.example", "http://bus.example/"]


@pytest.mark.parametrize("page, want", [
    (SHOP, {"title": "Seeds & Bulbs, A < B", "description": "Later one wins", "og:type": "shop", "og:locale": "en_GB"}),
    (TIMETABLE, {"title": ""}), (RECIPE, {}), (BLANK, {}),
])
def test_metadata(parsed, page, want):
    assert one(parsed, page, page_metadata("nodes")) == want


# selector, page, matched sources (in page order)
CASES = [
    ("div:not(#m)", SHOP, ['<div id="top" class="bar wide"><a href="/cart" rel="nofollow">Cart</a><a href="tel:+441632960000">Call</a></div>']),
    ("#top.bar > a:not([rel])", SHOP, ['<a href="tel:+441632960000">Call</a>']),
    ("th + th", SHOP, ["<th>Price\n"]),
    ("tr:nth-child(2) td:first-of-type", SHOP, ["<td>Queen of Night"]),
    ("[name='description']", SHOP, ['<meta name="description" content="Forty kinds of tulip">', '<meta name="description" content="Later one wins">']),
    ("a[href^='mailto:'], label input", TIMETABLE, ['<a href="mailto:desk@bus.example">Desk</a>', '<input name="s">']),
    ("li.now a", TIMETABLE, ['<a href="2">Two</a>']),
    ("h2 ~ ol > li:nth-of-type(2)", TIMETABLE, ["<li>Mill"]),
    ("nav li li", TIMETABLE, ['<li><a href="1/stops">Stops</a>']),
    ("h1 ~ ul > li li", RECIPE, ["<li>or water</li>"]),
    ("img:not([alt])", RECIPE, ['<img src="spoon.png">']),
    ("h4, .none", RECIPE, []),
    ("p", BLANK, []),
]


@pytest.mark.parametrize("sel, page, want", CASES)
def test_selector(parsed, sel, page, want):
    r = one(parsed, page, filter_by_selector("nodes", "html", sel))
    assert (r["count"], r.content) == (len(want), "\n".join(want))


def test_selector_invalid(parsed):
    r = one(parsed, SHOP, filter_by_selector("nodes", "html", "a >> b["))
    assert r.content is None and "Invalid CSS selector" in r.error
    with pytest.raises(ValueError, match="Invalid CSS selector"):
        filter_by_selector("nodes", "html", "a >> b[", on_error="raise")


def test_within_a_selector(parsed):
    nav = selected_subtrees("nodes", "nav")
    assert [x.text for x in one(parsed, TIMETABLE, page_links("nodes", None, within=nav))] == ["One", "Stops", "Two"]
    assert one(parsed, RECIPE, nodes_to_markdown(selected_subtrees("nodes", "blockquote, h3"), ["h3"])) == "> Salt late."
    assert one(parsed, SHOP, page_metadata(selected_subtrees("nodes", "body"))) == {}


def test_a_bad_page_stays_alone(spark):
    """100,000 nested tags, no content, and a stray ``<`` beside a good page."""
    from webtables.operators.parse import parse_pages

    rows = [(1, fx.DEEP), (2, None), (3, "<p>x < y</p>")]
    df = parse_pages(spark.createDataFrame(rows, "page_id long, html string"), markdown_strip=[])
    got = {r.page_id: r for r in df.select("page_id", "parse_error", "markdown", page_text("nodes").alias("text"), F.array_max(F.transform("nodes", lambda n: n["depth"])).alias("deep")).collect()}
    assert (got[1].text, got[1].markdown, got[1].parse_error) == ("bottom", "bottom", None) and got[1].deep == 100_000
    assert got[2].text is None and "no content" in got[2].parse_error
    assert (got[3].text, got[3].markdown) == ("x < y", "x < y")


def test_markdown_in_parse_pass_equals_udf(fixture_pages):
    from webtables.operators.parse import parse_pages

    for strip in ([], ["script", "style", "noscript"]):
        p = parse_pages(fixture_pages, keep_html=False, markdown_strip=strip)
        rows = p.select("markdown", nodes_to_markdown(F.col("nodes"), strip).alias("udf")).collect()
        assert all(r.markdown == r.udf for r in rows)


def test_markdown_rules():
    from webtables.functions.html import NODE_FIELDS, parse_html
    from webtables.functions.markdown import nodes_markdown

    h = ('<h2>T</h2><ul><li>a<ul><li>b<ul><li>c</li></ul></li></ul></li><li>d</li></ul>'
         '<ol><li>x</li><li>y</li></ol><p>Go <a href="http://e.com">http://e.com</a> <img src="i.png" alt="I"></p>'
         '<table><tr><th>h1</th><th>h2</th></tr><tr><td>1</td><td>2</td></tr></table>'
         '<blockquote>q</blockquote><hr><pre>code\n  x</pre><p>a_b*c</p>')
    md = nodes_markdown([dict(zip(NODE_FIELDS, n)) for n in parse_html(h)])
    assert md.startswith("## T\n\n* a\n    + b\n        - c\n* d\n\n1. x\n2. y")
    assert "Go <http://e.com> ![I](i.png)" in md
    assert "| h1 | h2 |\n| --- | --- |\n| 1 | 2 |" in md
    assert "> q" in md and "\n---\n" in md and "```\ncode\n  x\n```" in md
    assert "a\\_b\\*c" in md


SELECTOR_HTML = """<html><body>
<ul id="l"><li class="x y">1</li><li lang="en-US">2</li><li data-k="abc">3</li><li class="y">4</li><li>5</li></ul>
<div><p>a</p><span>s</span><p>b</p></div>
</body></html>"""

MORE = [
    ("li:nth-child(odd)", ["1", "3", "5"]),
    ("li:nth-child(2n)", ["2", "4"]),
    ("li:nth-child(-n+2)", ["1", "2"]),
    ("li:first-child", ["1"]),
    ("li[class~=y]", ["1", "4"]),
    ("li[lang|=en]", ["2"]),
    ("li[data-k$=bc]", ["3"]),
    ("li[data-k*=b]", ["3"]),
    ("li[data-k=abc]", ["3"]),
    ("#l > li.y:not(.x)", ["4"]),
    ("div > p:first-of-type", ["a"]),
    ("span ~ p", ["b"]),
    ("p + span", ["s"]),
    ("* > span", ["s"]),
    ("li ~ li.y", ["4"]),
    ("li ~ li ~ li", ["3", "4", "5"]),
    ("p ~ span, li ~ li", ["2", "3", "4", "5", "s"]),
]


@pytest.mark.parametrize("sel,texts", MORE)
def test_selector_features(spark, sel, texts):
    from webtables.operators.content import node_text
    from webtables.operators.parse import parse_pages
    from webtables.operators.selectors import match_nodes

    df = parse_pages(spark.createDataFrame([(1, SELECTOR_HTML)], "page_id long, html string"))
    got = df.select(F.transform(match_nodes("nodes", sel), lambda m: node_text(F.col("nodes"), m)).alias("t")).first().t
    assert got == texts


@pytest.mark.parametrize("bad", ["li:hover", "li::before", "a[href", "ul >", ", li", "li,,p", "li:nth-child(x)", ":is(a b)", "p:last-child(2)"])
def test_selector_unsupported_is_invalid(bad):
    from webtables.operators.selectors import compile_selector

    with pytest.raises(ValueError, match="Invalid CSS selector"):
        compile_selector(bad)


def test_extraction(parsed):
    """Thousands stay in one price and number; a date is no phone number."""
    from webtables.operators.audits import extract_data

    text = parsed.where("page_id = 0").select("page_id", page_text("nodes").alias("text"))
    got = {}
    for r in extract_data(text, "text").collect():
        got.setdefault(r.type, set()).add(r.value)
    assert got["price"] == {"$1,299.00", "€5"} and got["date"] == {"2031-05-17"} and got["phone"] == {"+44 (1632) 960-001"}
    assert "1,299.00" in got["number"] and "email" not in got


def test_a_phone_number_after_a_date(spark):
    """Dates are passed over; the number after one is found, and no part of a date is."""
    from webtables.operators.audits import extract_data

    rows = [(1, "2024-03-01 555 123 4567"), (2, "Posted 2024-03-01. 030 1234567"), (3, "2024-03-01 2024-03-02"), (4, "2024-03-01-555-123-4567"), (5, "555 123 4567")]
    got = extract_data(spark.createDataFrame(rows, "page_id long, text string"), "text", types=["phone"]).collect()
    assert sorted((r.page_id, r.value, r["count"]) for r in got) == [
        (1, "555 123 4567", 1), (2, "030 1234567", 1), (4, "555-123-4567", 1), (5, "555 123 4567", 1)]


def test_links_that_name_no_page(parsed):
    """``mailto:``, ``tel:`` and ``javascript:`` links are neither external nor broken."""
    from webtables.operators.audits import broken_links, link_audit, link_rows, linked_domains, normalize_url

    got = {r.page_id: (r.links, r.internal, r.external, r.missing_text, r.nofollow) for r in link_audit(parsed).collect()}
    assert got == {SHOP: (3, 1, 1, 0, 1), TIMETABLE: (6, 4, 0, 1, 0), RECIPE: (1, 1, 0, 0, 0), BLANK: (0, 0, 0, 0, 0)}
    pages = parsed.select("page_id", F.col("url").alias("src_url"))
    links = link_rows(parsed).withColumnRenamed("url", "dst_url").join(pages, "page_id").withColumnRenamed("page_id", "src_page_id")
    assert [(r.host, r.links, r.pages) for r in linked_domains(links).collect()] == [("other.example", 1, 1)]
    status = parsed.sparkSession.createDataFrame([("http://bus.example/1/", 200), ("http://bus.example/1", 500), ("http://bus.example/2", 404)], "url string, status_code int")
    broken = {(r.dst_url, r.reason, r.status_code) for r in broken_links(links, status).collect()}
    assert broken == {
        ("http://bus.example/1/stops", "unknown", None), ("http://bus.example/2", "bad_status", 404), ("http://bus.example/", "unknown", None),
        ("https://seeds.example/cart", "unknown", None), ("https://Other.example:8443/Tulips/?x=/#frag", "unknown", None), ("https://seeds.example/soups", "unknown", None),
    }
    assert links.select(normalize_url("dst_url").alias("n")).where("n LIKE '%tulips%' OR n LIKE '%Tulips%'").first().n == "https://other.example:8443/Tulips?x=/"
