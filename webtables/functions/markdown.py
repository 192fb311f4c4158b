"""Node rows -> markdown (the per-page helper behind ``nodes_to_markdown``).

Rules: ATX headings (``# h``), ``**strong**``/``*em*``, ``[text](href
"title")``, ``![alt](src "title")``, ``* `` / ``1. `` list items (bullets
``*``, ``+``, ``-`` by depth; nested lists indented), ``> `` quotes, fenced ``pre``, inline ``code``, ``---`` for
``hr``, pipe tables with a header rule, ``br`` as a hard break; script and
style content dropped; whitespace runs collapsed outside ``pre``; ``*`` and
``_`` in text escaped; the result trimmed.
"""

from __future__ import annotations

import re

_WS = re.compile(r"[ \t\r\n\f]+")
_BLANKS = re.compile(r"\n{3,}")
# Elements rendered as separate blocks.
BLOCK_TAGS = frozenset(
    "address article aside body dd div dl dt fieldset figcaption figure footer form header "
    "html main nav section summary details".split()
)
DROP_TAGS = frozenset(["script", "style", "template"])
# List bullets by nesting depth (markdownify's default).
BULLETS = "*+-"


def _escape(s: str) -> str:
    return s.replace("*", r"\*").replace("_", r"\_")


def _inline(s: str) -> str:
    return _WS.sub(" ", s).strip()


class _Place:
    """What an element's content is inside of, from its ancestors."""

    __slots__ = ("pre", "code", "depth", "ordered", "items", "rows", "silent")

    def __init__(self, pre=False, code=False, depth=0, ordered=False, items=None, rows=None, silent=False):
        self.pre, self.code, self.depth, self.ordered = pre, code, depth, ordered
        self.items, self.rows, self.silent = items, rows, silent

    def but(self, **changes) -> _Place:
        values = {k: getattr(self, k) for k in self.__slots__}
        return _Place(**(values | changes))


def _inside(n: dict, at: _Place) -> _Place:
    """The place of the children of element ``n``, itself at ``at``."""
    tag = n["tag"]
    if tag in DROP_TAGS:
        return at.but(silent=True)
    if tag == "code" and not at.pre:
        return at.but(code=True)
    if tag in ("ul", "ol"):
        return at.but(depth=at.depth + 1, ordered=tag == "ol", items=[0])
    if tag == "pre":
        return at.but(pre=True)
    if tag == "table":
        return at.but(rows=[0])
    return at


def _text(parts) -> str:
    """The text of nested lists of parts, whatever their depth."""
    if isinstance(parts, str):
        return parts
    out, stack = [], [iter(parts)]
    while stack:
        for p in stack[-1]:
            if isinstance(p, str):
                out.append(p)
            else:
                stack.append(iter(p))
                break
        else:
            stack.pop()
    return "".join(out)


def _render(n: dict, at: _Place, nth: int, kids: list):
    """The markdown of one element from its children's (``kids``: (node, parts) pairs).
    Where the children are only wrapped, nested parts save copying them."""
    tag = n["tag"]
    if tag in DROP_TAGS:
        return ""
    attrs = n["attrs"] or {}
    if isinstance(attrs, list):
        attrs = dict(attrs)
    parts = [p for _, p in kids]
    if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        return "\n\n" + "#" * int(tag[1]) + " " + _inline(_text(parts)) + "\n\n"
    if tag == "p":
        return "\n\n" + _text(parts).strip() + "\n\n"
    if tag in ("strong", "b", "em", "i"):
        inner, mark = _text(parts).strip(), "**" if tag in ("strong", "b") else "*"
        return f"{mark}{inner}{mark}" if inner else ""
    if tag == "code" and not at.pre:
        inner = _text(parts)
        return f"`{inner}`" if inner else ""
    if tag == "a":
        inner = _text(parts).strip()
        href, title = attrs.get("href"), attrs.get("title")
        if not href:
            return inner
        if inner == href and not title:
            return f"<{href}>"
        t = f' "{title}"' if title else ""
        return f"[{inner}]({href}{t})"
    if tag == "img":
        alt, src, title = attrs.get("alt", ""), attrs.get("src", ""), attrs.get("title")
        t = f' "{title}"' if title else ""
        return f"![{alt}]({src}{t})"
    if tag == "br":
        return "  \n"
    if tag == "hr":
        return "\n\n---\n\n"
    if tag in ("ul", "ol"):
        # a nested list hugs its parent item; a top-level list is a block
        return ["\n", *parts] if at.depth else ["\n\n", *parts, "\n"]
    if tag == "li":
        bullet = f"{nth}. " if at.ordered else BULLETS[(max(at.depth, 1) - 1) % len(BULLETS)] + " "
        inner = re.sub(r"\n\s*\n", "\n", _text(parts).strip("\n "))
        lines = inner.split("\n")
        return bullet + "\n".join([lines[0]] + [("    " + ln) if ln.strip() else "" for ln in lines[1:]]) + "\n"
    if tag == "blockquote":
        inner = _text(parts).strip()
        return "\n\n" + "\n".join("> " + ln if ln else ">" for ln in inner.split("\n")) + "\n\n"
    if tag == "pre":
        return "\n\n```\n" + _text(parts).strip("\n") + "\n```\n\n"
    if tag == "tr":
        cells = [_inline(_text(p)) for c, p in kids if c["kind"] == "element" and c["tag"] in ("td", "th")]
        row = "| " + " | ".join(cells) + " |\n"
        return row + "| " + " | ".join("---" for _ in cells) + " |\n" if nth == 1 else row
    if tag == "table":
        return ["\n\n", *parts, "\n"]
    if tag == "head":
        return [*parts, "\n\n"]
    if tag == "title":
        return _inline(_text(parts)) + "\n\n"
    return ["\n\n", *parts, "\n\n"] if tag in BLOCK_TAGS else parts


def _leaf(n: dict, at: _Place) -> str:
    if n["kind"] != "text" or at.silent:
        return ""
    t = n["text"] or ""
    if at.pre:
        return t
    return _WS.sub(" ", t) if at.code else _escape(_WS.sub(" ", t))


def without_subtrees(nodes: list[dict], tags: list[str] | None) -> list[dict]:
    """The nodes but those with one of ``tags`` and what lies below them. Also for parts of
    a page put together, where ids begin anew."""
    if not tags:
        return nodes
    tags, kept, gone, last = {t.lower() for t in tags}, [], -1, -1
    for n in nodes:
        if n["id"] <= last:
            gone = -1
        last = n["id"]
        if n["id"] <= gone:
            continue
        if n["tag"] in tags:
            gone = n["end_id"]
        else:
            kept.append(n)
    return kept


def nodes_markdown(nodes: list[dict] | None) -> str | None:
    """The markdown of nodes in document order. Two passes and no recursion: places are
    known from the parents on the way down, contents from the children on the way up. A
    node whose parent was left out, or belongs to another part of a page (ids begin anew),
    hangs from the root."""
    if nodes is None:
        return None
    row_of: dict[int, int] = {}
    parent, places, nth = [], [], []
    for i, n in enumerate(nodes):
        if i and n["id"] <= nodes[i - 1]["id"]:
            row_of = {}
        p = row_of.get(n["parent"], -1)
        at = places[p][1] if p >= 0 else _Place()
        parent.append(p)
        places.append((at, _inside(n, at)) if n["kind"] == "element" else (at, at))
        count = at.items if n["tag"] == "li" and at.ordered else at.rows if n["tag"] == "tr" else None
        if count is not None and not at.silent:
            count[0] += 1
        nth.append(count[0] if count is not None else 1)
        row_of[n["id"]] = i
    kids: list[list] = [[] for _ in nodes]
    top: list = []
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        got = _render(n, places[i][0], nth[i], kids[i][::-1]) if n["kind"] == "element" else _leaf(n, places[i][0])
        kids[i] = []
        if parent[i] >= 0:
            kids[parent[i]].append((n, got))
        else:
            top.append(got)
    out = _text(top[::-1])
    out = "\n".join(ln.rstrip(" ") if not ln.endswith("  ") else ln for ln in out.split("\n"))
    return _BLANKS.sub("\n\n", out).strip()
