"""P2/P12/P13/A10 (+ J4, J5, W5): CSS selectors over the node array.

A selector is compiled once on the driver; every compound becomes a Column predicate over
one node, and matches come out in document order, each once. Combinators never pair nodes
and never walk up a tree:

* child and adjacent sibling (J5) look up one node by its index;
* a descendant of a bare type (``nav a``) reads the node's set of ancestors' tags;
* all other descendant (J4) and general sibling steps are structural joins of the page
  with itself, one pass each over the nodes' intervals (``functions.structure``).

So matching is linear in the page at any depth. Supported: type and ``*``, ``#id``,
``.class``, ``[a]``, ``[a=v]``, ``[a~=v]``, ``[a|=v]``, ``[a^=v]``, ``[a$=v]``, ``[a*=v]``
(with ``i`` or ``s`` for the value's case), ``:nth-child``, ``:nth-last-child``,
``:nth-of-type``, ``:nth-last-of-type`` (``an+b``, odd, even), ``:first-child``,
``:last-child``, ``:only-child`` and the ``-of-type`` forms, ``:empty``, ``:root``,
``:not()``, ``:is()`` and ``:where()`` of compound lists, comma lists and the four
combinators. Anything else is an invalid selector (``ValueError: Invalid CSS selector
'...': ...``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webtables.functions import structure
from webtables.functions.html import tag_masks
from webtables.functions.text import _c, let
from webtables.operators.parse import has_ancestor, has_tag, nearest_above, node_at

_IDENT = r"-?(?:[_a-zA-Z]|[^\x00-\x7f]|\\.)(?:[-_a-zA-Z0-9]|[^\x00-\x7f]|\\.)*"
_TOKEN = re.compile(
    rf"""
    (?P<ws>\s+)
  | (?P<comb>[>+~])
  | (?P<comma>,)
  | (?P<star>\*)
  | (?P<type>{_IDENT})
  | \#(?P<id>{_IDENT})
  | \.(?P<cls>{_IDENT})
  | \[\s*(?P<attr>{_IDENT})\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>{_IDENT}))\s*(?P<case>[iIsS])?)?\s*\]
  | :(?P<pseudo>{_IDENT})(?:\((?P<arg>[^()]*(?:\([^()]*\))?[^()]*)\))?
    """,
    re.VERBOSE,
)


class SelectorError(ValueError):
    pass


@dataclass
class Compound:
    tag: str | None = None
    parts: list[tuple] = field(default_factory=list)


@dataclass
class Complex:
    # steps[0] has combinator None; later steps carry ' ', '>', '+', '~'
    steps: list[tuple[str | None, Compound]] = field(default_factory=list)


def _unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s)


def _nth(arg: str) -> tuple[int, int]:
    a = (arg or "").strip().lower().replace(" ", "")
    if a == "odd":
        return 2, 1
    if a == "even":
        return 2, 0
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?", a)
    if m:
        k = m.group(1)
        step = 1 if k in ("", "+") else -1 if k == "-" else int(k)
        return step, int(m.group(2) or 0)
    if re.fullmatch(r"[+-]?\d+", a):
        return 0, int(a)
    raise SelectorError(f"bad nth argument {arg!r}")


_NTH = ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type")
_SHORT = {
    "first-child": [("nth-child", 0, 1)],
    "last-child": [("nth-last-child", 0, 1)],
    "only-child": [("nth-child", 0, 1), ("nth-last-child", 0, 1)],
    "first-of-type": [("nth-of-type", 0, 1)],
    "last-of-type": [("nth-last-of-type", 0, 1)],
    "only-of-type": [("nth-of-type", 0, 1), ("nth-last-of-type", 0, 1)],
}


def parse_selector(text: str) -> list[Complex]:
    """Parse a selector list; raises SelectorError on anything unsupported."""
    if text is None or not text.strip():
        raise SelectorError("empty selector")
    pos, n = 0, len(text)
    out: list[Complex] = []
    cur = Complex()
    comp: Compound | None = None
    pending: str | None = None

    def close():
        nonlocal comp, pending
        if comp is not None:
            cur.steps.append((pending if cur.steps else None, comp))
            comp, pending = None, None

    while pos < n:
        m = _TOKEN.match(text, pos)
        if not m:
            raise SelectorError(f"unexpected {text[pos:pos + 10]!r} at position {pos}")
        pos = m.end()
        kind = m.lastgroup
        if kind in ("dq", "sq", "bare", "op", "case"):
            kind = "attr"
        if kind == "arg":
            kind = "pseudo"
        if kind == "ws":
            if comp is not None:
                close()
                pending = " "
            continue
        if kind == "comb":
            if comp is not None:
                close()
            if not cur.steps:
                raise SelectorError("combinator without a left side")
            pending = m.group("comb")
            continue
        if kind == "comma":
            close()
            if not cur.steps or pending not in (None, " "):
                raise SelectorError("empty item in selector list")
            out.append(cur)
            cur, pending = Complex(), None
            continue
        if comp is None:
            if cur.steps and pending is None:
                raise SelectorError("missing combinator")
            comp = Compound()
        if kind in ("star", "type"):
            if comp.tag is not None or comp.parts:
                raise SelectorError("type selector must come first")
            comp.tag = "*" if kind == "star" else _unescape(m.group("type")).lower()
        elif kind == "id":
            comp.parts.append(("id", _unescape(m.group("id"))))
        elif kind == "cls":
            comp.parts.append(("class", _unescape(m.group("cls"))))
        elif kind == "attr":
            val = m.group("dq") if m.group("dq") is not None else m.group("sq") if m.group("sq") is not None else m.group("bare")
            fold = (m.group("case") or "s").lower() == "i"
            comp.parts.append(("attr", _unescape(m.group("attr")).lower(), m.group("op"), None if val is None else _unescape(val), fold))
        elif kind == "pseudo":
            name, arg = m.group("pseudo").lower(), m.group("arg")
            if name in _NTH and arg is not None:
                comp.parts.append((name, *_nth(arg)))
            elif name in _SHORT and arg is None:
                comp.parts += _SHORT[name]
            elif name in ("empty", "root") and arg is None:
                comp.parts.append((name,))
            elif name in ("not", "is", "where") and arg:
                inner = parse_selector(arg)
                if any(len(cx.steps) != 1 for cx in inner):
                    raise SelectorError(f":{name}() takes compound selectors")
                comp.parts.append(("not" if name == "not" else "is", [cx.steps[0][1] for cx in inner]))
            else:
                raise SelectorError(f"unsupported pseudo-class :{name}")
    close()
    if pending is not None and pending != " ":
        raise SelectorError("dangling combinator")
    if not cur.steps:
        raise SelectorError("empty item in selector list")
    out.append(cur)
    return out


# --- compilation to Columns ------------------------------------------------

def _pos_match(pos: Column, a: int, b: int) -> Column:
    if a == 0:
        return pos == b
    d = pos - b
    return (d % a == 0) & ((d / a) >= 0)


def _compound_pred(c: Compound, n: Column) -> Column:
    attrs = n["attrs"]
    p = n["kind"] == "element"
    if c.tag not in (None, "*"):
        p = p & (n["tag"] == c.tag)
    for part in c.parts:
        kind = part[0]
        if kind == "id":
            p = p & F.coalesce(attrs["id"] == part[1], F.lit(False))
        elif kind == "class":
            p = p & F.coalesce(F.array_contains(F.split(attrs["class"], r"[ \t\n\r\f]+"), part[1]), F.lit(False))
        elif kind == "attr":
            _, name, op, val, fold = part
            v = F.lower(attrs[name]) if fold else attrs[name]
            val = val.lower() if fold and val else val
            if op is None:
                q = F.map_contains_key(attrs, name)
            elif op == "=":
                q = v == val
            elif op == "~=":
                q = F.array_contains(F.split(v, r"[ \t\n\r\f]+"), val) if val and not re.search(r"[ \t\n\r\f]", val) else F.lit(False)
            elif op == "|=":
                q = (v == val) | v.startswith(val + "-")
            elif op == "^=":
                q = v.startswith(val) if val else F.lit(False)
            elif op == "$=":
                q = v.endswith(val) if val else F.lit(False)
            else:  # *=
                q = v.contains(val) if val else F.lit(False)
            p = p & F.coalesce(q, F.lit(False))
        elif kind == "nth-child":
            p = p & _pos_match(n["sib"], part[1], part[2])
        elif kind == "nth-of-type":
            p = p & _pos_match(n["type_sib"], part[1], part[2])
        elif kind == "nth-last-child":
            p = p & _pos_match(n["n_sib"] - n["sib"] + 1, part[1], part[2])
        elif kind == "nth-last-of-type":
            p = p & _pos_match(n["n_type"] - n["type_sib"] + 1, part[1], part[2])
        elif kind == "empty":
            p = p & (n["kids"] == 0)
        elif kind == "root":
            p = p & (n["parent"] < 0)
        elif kind in ("not", "is"):
            one = None
            for c in part[1]:
                q = _compound_pred(c, n)
                one = q if one is None else one | q
            p = p & (~one if kind == "not" else one)
    return p


def _native(cx: Complex) -> bool:
    """Whether node lookups and sets of ancestors' tags decide the selector: no general
    sibling, and a descendant step only after one bare, known type."""
    for i, (comb, _) in enumerate(cx.steps):
        if comb == "~":
            return False
        if comb == " ":
            left = cx.steps[0][1]
            if i != 1 or left.parts or left.tag in (None, "*") or tag_masks([left.tag]) is None:
                return False
    return True


def _complex_pred(cx: Complex, nodes: Column, n: Column, idx: int | None = None) -> Column:
    """A selector that :func:`_native` accepts, as a predicate of one node."""
    idx = len(cx.steps) - 1 if idx is None else idx
    comb, comp = cx.steps[idx]
    p = _compound_pred(comp, n)
    if idx == 0:
        return p
    left = lambda m: _complex_pred(cx, nodes, m, idx - 1)
    if comb == " ":
        rel = has_ancestor(n, [cx.steps[0][1].tag])
    elif comb == ">":
        rel = (n["parent"] >= 0) & left(node_at(nodes, n["parent"]))
    else:  # "+"
        rel = n["prev_sib"].isNotNull() & left(node_at(nodes, n["prev_sib"]))
    return p & F.coalesce(rel, F.lit(False))


def compile_selector(selector: str) -> list[Complex]:
    """The parsed selector list; raises ValueError with the reference's message for an
    invalid selector."""
    try:
        return parse_selector(selector)
    except SelectorError as e:
        raise ValueError(f"Invalid CSS selector '{selector}': {e}") from e


#: Compounds that one set of flags holds.
_MOST_COMPOUNDS = 62


def selection(nodes: Column, selector: str) -> tuple[Column, list]:
    """A selector as numbers: for each node the bits of the compounds that it meets, and for
    each selector of the list its steps (combinator, bit), see ``functions.structure``."""
    tree = compile_selector(selector)
    compounds = [comp for cx in tree for _, comp in cx.steps]
    if len(compounds) > _MOST_COMPOUNDS:
        raise ValueError(f"Invalid CSS selector '{selector}': more than {_MOST_COMPOUNDS} steps")
    program, bit = [], 0
    for cx in tree:
        program.append([(comb, bit + i) for i, (comb, _) in enumerate(cx.steps)])
        bit += len(cx.steps)

    def flags(n: Column) -> Column:
        out = None
        for i, comp in enumerate(compounds):
            q = F.when(F.coalesce(_compound_pred(comp, n), F.lit(False)), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
            out = q if out is None else out + q
        return out

    return F.transform(nodes, flags), program


def _hits(nodes: Column, selector: str) -> Column:
    """A boolean for each node of the page, by passes over the page's intervals."""
    flags, program = selection(nodes, selector)

    @F.arrow_udf(T.ArrayType(T.BooleanType()))
    def select(flags: pa.Array, parents: pa.Array, ends: pa.Array, prevs: pa.Array) -> pa.Array:
        return structure.select_lists(flags, parents, ends, prevs, program)

    return select(flags, F.transform(nodes, lambda n: n["parent"]), F.transform(nodes, lambda n: n["end_id"]), F.transform(nodes, lambda n: n["prev_sib"]))


def _matches(nodes: Column, selector: str) -> Column | None:
    """The matched elements by lookups alone; None where it takes a structural join."""
    tree = compile_selector(selector)
    if not all(_native(cx) for cx in tree):
        return None

    def one(n: Column) -> Column:
        out = None
        for cx in tree:
            q = _complex_pred(cx, nodes, n)
            out = q if out is None else out | q
        return out

    return F.filter(nodes, one)


def match_nodes(nodes, selector: str) -> Column:
    """Matched elements of a whole page in document order (each once)."""
    nodes = _c(nodes)
    found = _matches(nodes, selector)
    if found is not None:
        return found
    return let(_hits(nodes, selector), lambda hit: F.filter(nodes, lambda n, i: F.get(hit, i)))


def outer_html(html, matched: Column) -> Column:
    """Outer HTML of each match (source text of the element)."""
    return F.transform(matched, lambda m: F.substring(_c(html), m["start"] + 1, m["stop"] - m["start"]))


def filter_by_selector(nodes, html, selector: str | None, on_error: str = "row") -> Column:
    """``struct(content, count, error)``: matched outer HTML joined by
    newlines and the match count; ``("", 0)`` when nothing matches. An
    empty or null selector means no selector (the page unchanged). An
    invalid selector fails every row (``on_error="row"``) or raises."""
    if not selector:
        return F.struct(_c(html).alias("content"), F.lit(None).cast("int").alias("count"),
                        F.lit(None).cast("string").alias("error"))
    try:
        m = match_nodes(nodes, selector)
    except ValueError as e:
        if on_error == "raise":
            raise
        return F.struct(F.lit(None).cast("string").alias("content"), F.lit(None).cast("int").alias("count"),
                        F.lit(f"ValueError: {e}").alias("error"))
    return F.struct(
        F.array_join(outer_html(html, m), "\n").alias("content"),
        F.size(m).alias("count"),
        F.lit(None).cast("string").alias("error"),
    )


def selected_subtrees(nodes, selector: str, strip_tags: list[str] | None = None) -> Column:
    """The nodes of every matched subtree, concatenated (a nested match appears twice,
    as in the re-parsed filtered HTML), without the elements of ``strip_tags`` and what is
    inside them. Conversions after a selector (text, metadata) run on this array.

    What is stripped is decided inside each match: a node goes if the nearest stripped
    element above it is the match itself or lies inside it, which one pass over the page
    tells for all matches."""
    nodes, strip = _c(nodes), [t.lower() for t in strip_tags or []]
    found = _matches(nodes, selector)
    # all that Python computes is bound at once: functions of rows cannot be nested
    bound = F.struct(
        (F.lit(None).cast("array<boolean>") if found is not None else _hits(nodes, selector)).alias("hit"),
        (nearest_above(nodes, lambda n: has_tag(n, strip)) if strip else F.lit(None).cast("array<int>")).alias("near"),
    )

    def parts(t: Column) -> Column:
        hits = found if found is not None else F.filter(nodes, lambda n, i: F.get(t["hit"], i))

        def part(e: Column) -> Column:
            whole = F.slice(nodes, e["id"] + 1, e["end_id"] - e["id"] + 1)
            if not strip:
                return whole
            return F.filter(whole, lambda n, i: ~has_tag(n, strip) & (F.get(t["near"], e["id"] + i) < e["id"]))

        return F.flatten(F.transform(hits, part))

    return let(bound, parts)
