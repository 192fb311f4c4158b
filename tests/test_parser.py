"""The tree builder's stated repair rules (pure Python, no Spark)."""

from webtables.functions.html import NESTING_TAGS, NODE_FIELDS, parse_html, tag_masks
from webtables.functions.markdown import nodes_markdown

F = {n: i for i, n in enumerate(NODE_FIELDS)}


def tree(html):
    """(tag or '#text', depth) for elements and text, in document order."""
    out = []
    for n in parse_html(html):
        if n[F["kind"]] == "element":
            out.append((n[F["tag"]], n[F["depth"]]))
        elif n[F["kind"]] in ("text", "raw"):
            out.append(("#" + n[F["text"]], n[F["depth"]]))
    return out


def test_block_start_closes_p():
    assert tree("<p>a<div>b</div>") == [("p", 0), ("#a", 1), ("div", 0), ("#b", 1)]
    assert tree("<p><b>x<p>y") == [("p", 0), ("b", 1), ("#x", 2), ("p", 0), ("#y", 1)]


def test_implied_ends():
    assert tree("<ul><li>a<li>b</ul>") == [("ul", 0), ("li", 1), ("#a", 2), ("li", 1), ("#b", 2)]
    t = tree("<table><tr><td>1<td>2<tr><td>3</table>")
    assert [x for x in t if x[0] in ("tr", "td")] == [("tr", 1), ("td", 2), ("td", 2), ("tr", 1), ("td", 2)]


def test_unmatched_end_ignored_and_end_closes_children():
    assert tree("<div>a</span>b</div>") == [("div", 0), ("#ab", 1)]
    assert tree("<div><span>a</div>b") == [("div", 0), ("span", 1), ("#a", 2), ("#b", 0)]


def test_void_and_self_closing_are_leaves():
    assert tree("<p>a<br>b<img src=x>c</p>") == [("p", 0), ("#a", 1), ("br", 1), ("#b", 1), ("img", 1), ("#c", 1)]
    assert tree("<div><x-icon/>t</div>") == [("div", 0), ("x-icon", 1), ("#t", 1)]


def test_attributes_entities_and_raw_text():
    nodes = parse_html('<a HREF="/a?x=1&amp;y=2" href="/second" disabled title=\'T &quot;q&quot;\'>A &amp; B</a>'
                       '<script>if (a < b) { x = "</p>"; }</script><!-- note -->')
    a = nodes[0]
    assert a[F["attrs"]] == {"href": "/a?x=1&y=2", "disabled": "", "title": 'T "q"'}  # first duplicate wins
    assert nodes[1][F["text"]] == "A & B"
    script = [n for n in nodes if n[F["tag"]] == "script"][0]
    raw = nodes[script[F["id"]] + 1]
    assert raw[F["kind"]] == "raw" and raw[F["text"]] == 'if (a < b) { x = "</p>"; }'
    assert nodes[-1][F["kind"]] == "comment" and nodes[-1][F["text"]] == " note "


def test_preorder_ids_and_subtree_slices():
    html = "<html><body><nav><a href='/h'>H</a></nav><main><p>x<b>y</b></p></main></body></html>"
    nodes = parse_html(html)
    for n in nodes:
        assert nodes[n[F["id"]]] is n
        sub = nodes[n[F["id"]] + 1 : n[F["end_id"]] + 1]
        inside = [s for s in nodes if s is not n and n[F["id"]] in ancestors(nodes, s)]
        assert sub == inside
        if n[F["kind"]] == "element":
            assert html[n[F["start"]] : n[F["stop"]]].startswith("<" + n[F["tag"]])


def ancestors(nodes, n):
    out = []
    while n[F["parent"]] >= 0:
        n = nodes[n[F["parent"]]]
        out.append(n[F["id"]])
    return out


def test_sets_of_ancestors_and_counts():
    html = "<div><p>a<b>c<!-- x --></b></p><p></p><my-tag><i>d</i><p>e</p></my-tag></div><hr><div></div>"
    nodes = parse_html(html)
    for n in nodes:
        above = {nodes[i][F["tag"]] for i in ancestors(nodes, n)}
        for tag in ("div", "p", "b", "i", "table"):
            m0, m1 = tag_masks([tag])
            assert bool(n[F["up0"]] & m0 or n[F["up1"]] & m1) == (tag in above)
        same = [s for s in nodes if s[F["parent"]] == n[F["parent"]] and s[F["kind"]] == "element"]
        if n[F["kind"]] == "element":
            assert n[F["n_sib"]] == len(same) and n[F["n_type"]] == sum(s[F["tag"]] == n[F["tag"]] for s in same)
            kids = [s for s in nodes if s[F["parent"]] == n[F["id"]] and s[F["kind"]] != "comment"]
            assert n[F["kids"]] == len(kids)
    assert tag_masks(["my-tag"]) is None and tag_masks(["br"]) == (0, 0)
    assert len(set(NESTING_TAGS)) == len(NESTING_TAGS) <= 2 * 62


def test_any_depth():
    n = 100_000
    nodes = parse_html("<div>" * n + "bottom")
    assert len(nodes) == n + 1 and nodes[-1][F["depth"]] == n and nodes[0][F["end_id"]] == n
    late = parse_html("<p><table>" + "<font>" * 20_000 + "<div>" * 20_000 + "x</table>y")
    assert late[-1][F["text"]] == "y" and late[-1][F["depth"]] == 0
    assert nodes_markdown([dict(zip(NODE_FIELDS, r)) for r in parse_html("<b>" * 3000 + "x")]).count("x") == 1


def test_sibling_positions():
    nodes = parse_html("<div><p>a</p><span>s</span><p>b</p></div>")
    els = [(n[F["tag"]], n[F["sib"]], n[F["type_sib"]], n[F["prev_sib"]]) for n in nodes if n[F["kind"]] == "element"]
    assert els == [("div", 1, 1, None), ("p", 1, 1, None), ("span", 2, 1, 1), ("p", 3, 2, 3)]
