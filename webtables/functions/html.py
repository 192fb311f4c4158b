"""Per-page HTML tree builder (the small per-row helper behind ``parse_pages``).

The stdlib tokenizer reports tags and text but repairs nothing; this helper
keeps an open-element stack and applies a few stated rules:

* void elements are leaves and their end tags are ignored;
* ``script``/``style`` content is raw text (kind ``raw``), never markup;
* an end tag closes every element opened after its match; an end tag with
  no open match is ignored;
* a block start closes an open ``p``; ``li``/``dt``/``dd``/``tr``/``td``/
  ``th``/``option`` close an open sibling of the same family;
* the document end closes everything;
* text that the tokenizer hands out in pieces (around a stray ``<``) is one node.

Nodes come out in pre-order, so ``id`` equals the array position and the
subtree of node ``i`` is exactly ``nodes[i+1 .. end_id]``. A node holds numbers only
about its place (parent, end, the set of its ancestors' tags as two bit sets), so a page
takes memory and time linear in its size however deep it nests.
"""

from __future__ import annotations

from html.parser import HTMLParser

# HTML void elements (HTML Living Standard, "void elements").
VOID_TAGS = frozenset(
    "area base br col embed hr img input keygen link meta param source track wbr".split()
)
# Start tags that close an open <p> (HTML Living Standard, "in body").
CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section "
    "summary table ul".split()
)
# Start tags that close an open element of the same family, and
# the tags that stop the search for it.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "tr": ({"tr"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
}
# Elements that bound the search for an open <p>.
P_SCOPE = frozenset("html body table td th caption button object applet marquee template".split())

NODE_FIELDS = (
    "id", "parent", "end_id", "depth", "sib", "type_sib", "n_sib", "n_type", "prev_sib", "kids",
    "kind", "tag", "attrs", "text", "up0", "up1", "start", "stop",
)
_END, _NSIB, _NTYPE, _KIDS, _KIND, _TAG, _TEXT, _STOP = (NODE_FIELDS.index(f) for f in ("end_id", "n_sib", "n_type", "kids", "kind", "tag", "text", "stop"))

# Elements that can hold others (HTML Living Standard and its obsolete ones);
# a tag's place is its bit in the sets of ancestors' tags.
NESTING_TAGS = (
    "a abbr acronym address applet article aside audio b bdi bdo big blink blockquote body "
    "button canvas caption center cite code colgroup data datalist dd del details dfn dialog "
    "dir div dl dt em fieldset figcaption figure font footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup html i iframe ins kbd label legend li main map mark marquee math menu "
    "meter nav nobr noframes noscript object ol optgroup option output p picture pre progress "
    "q rp rt ruby s samp script search section select slot small span strike strong style sub "
    "summary sup svg table tbody td template textarea tfoot th thead time title tr tt u ul var "
    "video"
).split()
WORD_BITS = 62
TAG_BIT = {t: (i // WORD_BITS, 1 << i % WORD_BITS) for i, t in enumerate(NESTING_TAGS)}


def tag_masks(tags) -> tuple[int, int] | None:
    """The bits of ``tags`` in ``up0`` and ``up1``; None if a set of ancestors cannot tell
    (a tag that is neither known nor void, as of a custom element)."""
    masks = [0, 0]
    for t in tags:
        if t in TAG_BIT:
            word, bit = TAG_BIT[t]
            masks[word] |= bit
        elif t not in VOID_TAGS:
            return None
    return masks[0], masks[1]


# Elements whose content is raw text (HTML Living Standard).
RAW_TAGS = frozenset(["script", "style"])


class _TreeBuilder(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.html = html
        self.line_starts = [0]
        i = html.find("\n")
        while i >= 0:
            self.line_starts.append(i + 1)
            i = html.find("\n", i + 1)
        self.nodes: list[list] = []
        # open elements: [node_id, tag, child_count, {tag: count}, last_child_id,
        # tags of the ancestors and itself (two bit sets), element children's ids]
        self.stack: list[list] = []
        self.root = [-1, None, 0, {}, None, 0, 0, []]
        self.open_at: dict[str, list[int]] = {}  # where in the stack each tag is open

    # -- positions -------------------------------------------------------
    def _offset(self) -> int:
        line, col = self.getpos()
        return self.line_starts[line - 1] + col

    # -- stack helpers ---------------------------------------------------
    def _close(self, entry: list) -> None:
        """Tell the element children of a closed element how many they are."""
        for c in entry[7]:
            node = self.nodes[c]
            node[_NSIB] = entry[2]
            node[_NTYPE] = entry[3][node[_TAG]]

    def _pop_to(self, depth: int, stop: int) -> None:
        """Close every open element at stack depth >= ``depth``."""
        last = len(self.nodes) - 1
        while len(self.stack) > depth:
            entry = self.stack.pop()
            self.open_at[entry[1]].pop()
            node = self.nodes[entry[0]]
            node[_END] = last
            node[_STOP] = stop
            self._close(entry)

    def _last_open(self, tags) -> int:
        return max((self.open_at[t][-1] for t in tags if self.open_at.get(t)), default=-1)

    def _find_open(self, targets, boundary) -> int:
        at = self._last_open(targets)
        return at if at > self._last_open(boundary - targets) else -1

    def _new_node(self, kind, tag, attrs, text, start, stop) -> int:
        nid = len(self.nodes)
        top = self.stack[-1] if self.stack else self.root
        sib = type_sib = prev = None
        if kind == "element":
            top[2] += 1
            sib, prev = top[2], top[4]
            top[4] = nid
            type_sib = top[3][tag] = top[3].get(tag, 0) + 1
            top[7].append(nid)
        if kind != "comment" and self.stack:
            self.nodes[top[0]][_KIDS] += 1
        self.nodes.append(
            [nid, top[0], nid, len(self.stack), sib, type_sib, None, None, prev, 0, kind, tag, attrs, text,
             top[5], top[6], start, stop]
        )
        return nid

    # -- tokenizer callbacks ---------------------------------------------
    def _open(self, tag, attrs, self_closing):
        start = self._offset()
        raw = self.get_starttag_text() or ""
        stop = start + len(raw)
        if tag in CLOSES_P:
            i = self._find_open({"p"}, P_SCOPE)
            if i >= 0:
                self._pop_to(i, start)
        rule = IMPLIED_END.get(tag)
        if rule is not None:
            i = self._find_open(rule[0], rule[1])
            if i >= 0:
                self._pop_to(i, start)
        amap: dict[str, str] = {}
        for k, v in attrs:
            if k not in amap:
                amap[k] = "" if v is None else v
        nid = self._new_node("element", tag, amap, None, start, stop)
        if not (self_closing or tag in VOID_TAGS):
            top = self.stack[-1] if self.stack else self.root
            up = [top[5], top[6]]
            if tag in TAG_BIT:
                word, bit = TAG_BIT[tag]
                up[word] |= bit
            self.open_at.setdefault(tag, []).append(len(self.stack))
            self.stack.append([nid, tag, 0, {}, None, up[0], up[1], []])

    def handle_starttag(self, tag, attrs):
        self._open(tag, attrs, False)

    def handle_startendtag(self, tag, attrs):
        self._open(tag, attrs, True)

    def handle_endtag(self, tag):
        if tag in VOID_TAGS:
            return
        i = self._last_open([tag])
        if i >= 0:
            start = self._offset()
            end = self.html.find(">", start)
            self._pop_to(i + 1, start)  # what the end tag closes on its way ends before it
            self._pop_to(i, len(self.html) if end < 0 else end + 1)

    def handle_data(self, data):
        start = self._offset()
        kind = "raw" if self.stack and self.stack[-1][1] in RAW_TAGS else "text"
        last = self.nodes[-1] if self.nodes else None
        if last is not None and last[_KIND] == kind and last[1] == (self.stack[-1][0] if self.stack else -1):
            last[_TEXT] += data
            last[_STOP] = start + len(data)
            return
        self._new_node(kind, None, None, data, start, start + len(data))

    def handle_comment(self, data):
        start = self._offset()
        self._new_node("comment", None, None, data, start, start + len(data) + 7)

    def finish(self) -> list[list]:
        self.close()
        self._pop_to(0, len(self.html))
        self._close(self.root)
        return self.nodes


def parse_html(html: str) -> list[list]:
    """Return the node rows of one page, in pre-order (see ``NODE_FIELDS``)."""
    b = _TreeBuilder(html)
    b.feed(html)
    return b.finish()


__all__ = ["parse_html", "tag_masks", "NESTING_TAGS", "NODE_FIELDS", "VOID_TAGS"]
