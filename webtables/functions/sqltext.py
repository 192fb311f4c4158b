"""H5 and H3 as SQL text: the same expressions as ``functions.urls`` and
``operators.content``, parsed by Catalyst from one string.

Building the equivalent Column tree from Python takes thousands of py4j
calls per use; one ``F.expr`` of this text is one call. Used when the
arguments are column names (the common case); Column arguments take the
Column builders. Both produce the same plan."""

from __future__ import annotations

import itertools

from webtables.functions.html import TAG_BIT, tag_masks
from webtables.functions.urls import USES_RELATIVE

_ids = itertools.count()

SPLIT_RE = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"
WS = r"[\p{IsWhite_Space}\x{1c}-\x{1f}]"
_REL = ", ".join(f"'{s}'" for s in USES_RELATIVE)


def _v(prefix: str) -> str:
    return f"{prefix}_{next(_ids)}"


def name(col: str) -> str:
    return "`" + col.replace("`", "``") + "`"


def let(value: str, body) -> str:
    v = _v("v")
    return f"get(transform(array({value}), {v} -> {body(v)}), 0)"


def url_parts(u: str) -> str:
    clean = f"regexp_replace(regexp_replace({u}, r'^[\\x{{00}}-\\x{{20}}]+', ''), r'[\\t\\r\\n]', '')"

    def parts(c: str) -> str:
        g = lambda k: f"regexp_extract({c}, r'{SPLIT_RE}', {k})"
        return (f"named_struct('scheme', lower({g(1)}), 'has_net', {g(3)} <> '', 'net', {g(3)}, "
                f"'path', {g(4)}, 'query', {g(6)}, 'frag', {g(8)})")

    return let(clean, parts)


def _unsplit(sch: str, net: str, path: str, query: str, frag: str) -> str:
    def body(p: str) -> str:
        p2 = f"CASE WHEN {net} <> '' AND {p} <> '' AND NOT startswith({p}, '/') THEN concat('/', {p}) ELSE {p} END"
        return (f"concat(CASE WHEN {sch} <> '' THEN concat({sch}, ':') ELSE '' END, "
                f"CASE WHEN {net} <> '' THEN concat('//', {net}) ELSE '' END, {p2}, "
                f"CASE WHEN {query} <> '' THEN concat('?', {query}) ELSE '' END, "
                f"CASE WHEN {frag} <> '' THEN concat('#', {frag}) ELSE '' END)")

    return let(path, body)


def _remove_dots(segs: str) -> str:
    def body(sg: str) -> str:
        acc, s = _v("acc"), _v("s")
        out = (f"aggregate({sg}, cast(array() as array<string>), ({acc}, {s}) -> CASE WHEN {s} = '..' "
               f"THEN slice({acc}, 1, greatest(size({acc}) - 1, 0)) WHEN {s} = '.' THEN {acc} "
               f"ELSE concat({acc}, array({s})) END)")
        out = f"CASE WHEN try_element_at({sg}, -1) IN ('.', '..') THEN concat({out}, array('')) ELSE {out} END"
        return let(f"array_join({out}, '/')", lambda j: f"CASE WHEN {j} = '' THEN '/' ELSE {j} END")

    return let(segs, body)


def _merge_paths(bpath: str, hpath: str) -> str:
    def merged(bp: str) -> str:
        bparts = f"CASE WHEN try_element_at({bp}, -1) <> '' THEN slice({bp}, 1, size({bp}) - 1) ELSE {bp} END"

        def drop_middle(rel: str) -> str:
            s = _v("s")
            return (f"concat(slice({rel}, 1, 1), filter(slice({rel}, 2, size({rel}) - 2), {s} -> {s} <> ''), "
                    f"slice({rel}, size({rel}), 1))")

        return _remove_dots(let(f"concat({bparts}, split({hpath}, '/', -1))", drop_middle))

    return (f"CASE WHEN startswith({hpath}, '/') THEN {_remove_dots(f'split({hpath}, {chr(39)}/{chr(39)}, -1)')} "
            f"ELSE {let(f'split({bpath}, {chr(39)}/{chr(39)}, -1)', merged)} END")


def resolve_parts(bp: str, base: str, h: str) -> str:
    """H5 with the base parsed (``bp`` names a ``url_parts`` struct)."""
    plain = (f"(startswith({h}, '/') AND NOT startswith({h}, '//') AND NOT contains({h}, '/.') "
             f"AND NOT endswith({h}, '?') AND NOT endswith({h}, '#') AND NOT contains({h}, '?#') "
             f"AND NOT {h} rlike r'[\\x{{00}}-\\x{{20}}\\x{{7f}}]')")
    fast = f"({bp}.scheme IN ({_REL}) AND {bp}.scheme <> '' AND {plain})"

    def full(hp: str) -> str:
        sch = f"(CASE WHEN {hp}.scheme = '' THEN {bp}.scheme ELSE {hp}.scheme END)"
        ok = f"({sch} IN ({_REL}) AND {sch} = {bp}.scheme)"
        return (f"CASE WHEN NOT {ok} THEN {h} "
                f"WHEN {hp}.has_net THEN {_unsplit(sch, f'{hp}.net', f'{hp}.path', f'{hp}.query', f'{hp}.frag')} "
                f"WHEN {hp}.path = '' THEN {_unsplit(sch, f'{bp}.net', f'{bp}.path', f'(CASE WHEN {hp}.query = {chr(39)}{chr(39)} THEN {bp}.query ELSE {hp}.query END)', f'{hp}.frag')} "
                f"ELSE {_unsplit(sch, f'{bp}.net', _merge_paths(f'{bp}.path', f'{hp}.path'), f'{hp}.query', f'{hp}.frag')} END")

    return (f"CASE WHEN {base} IS NULL OR {base} = '' THEN {h} WHEN {h} = '' THEN {base} "
            f"WHEN {fast} THEN concat({bp}.scheme, ':', CASE WHEN {bp}.net <> '' THEN concat('//', {bp}.net) ELSE '' END, {h}) "
            f"ELSE {let(url_parts(h), full)} END")


def resolve_url(base: str, href: str) -> str:
    return let(url_parts(base), lambda bp: resolve_parts(bp, base, href))


def ustrip(s: str) -> str:
    return f"regexp_replace({s}, r'^{WS}+|{WS}+$', '')"


def page_links(nodes: str, base: str | None, within: str | None = None) -> str:
    """H3 over column names: ``array<struct<url, text, title>>``."""
    src = within or nodes
    n, a, t, x = _v("n"), _v("a"), _v("t"), _v("x")
    anchors = f"filter({src}, {n} -> {n}.tag = 'a' AND map_contains_key({n}.attrs, 'href'))"
    text = (f"array_join(filter(transform(filter(slice({nodes}, {a}.id + 2, {a}.end_id - {a}.id), {t} -> {t}.kind = 'text'), "
            f"{t} -> {ustrip(f'{t}.text')}), {x} -> {x} <> ''), '')")
    if base is None:
        url = f"{a}.attrs['href']"
        return (f"transform({anchors}, {a} -> named_struct('url', {url}, 'text', {text}, "
                f"'title', coalesce({a}.attrs['title'], '')))")

    def with_base(bp: str) -> str:
        url = resolve_parts(bp, base, f"{a}.attrs['href']")
        return (f"transform({anchors}, {a} -> named_struct('url', {url}, 'text', {text}, "
                f"'title', coalesce({a}.attrs['title'], '')))")

    return let(url_parts(base), with_base)


def page_text(nodes: str, strip_tags: list[str]) -> str:
    """H1 over a column name of whole pages (``strip_tags`` already defaulted, known tags)."""
    n, k, l1, l2 = _v("n"), _v("k"), _v("l"), _v("l")
    src = nodes
    if strip_tags:
        low = [t.lower() for t in strip_tags]
        m0, m1 = tag_masks(low)
        tags = ", ".join("'" + t.replace("'", "''") + "'" for t in low)
        src = (f"filter({nodes}, {n} -> NOT (coalesce({n}.tag IN ({tags}), false) "
               f"OR ({n}.up0 & {m0}L) <> 0 OR ({n}.up1 & {m1}L) <> 0))")
    kept = f"filter({src}, {k} -> {k}.kind = 'text')"
    lines = f"flatten(transform({kept}, {k} -> split({k}.text, r'\\n')))"
    return f"array_join(filter(transform({lines}, {l1} -> {ustrip(l1)}), {l2} -> {l2} <> ''), char(10))"


def page_metadata(nodes: str) -> str:
    """H4 over a column name (see ``operators.content.page_metadata``)."""
    n = _v("n")
    word, bit = TAG_BIT["title"]
    small = (f"filter({nodes}, {n} -> {n}.tag IN ('title', 'meta') "
             f"OR ({n}.tag IS NULL AND ({n}.up{word} & {bit}L) <> 0))")

    def build(sm: str) -> str:
        m, e, t, k = _v("m"), _v("e"), _v("t"), _v("k")
        entries = (f"filter(transform(filter({sm}, {m} -> {m}.tag = 'meta'), {m} -> named_struct("
                   f"'key', coalesce(nullif({m}.attrs['name'], ''), {m}.attrs['property']), 'value', {m}.attrs['content'])), "
                   f"{e} -> coalesce({e}.key, '') <> '' AND coalesce({e}.value, '') <> '')")

        def with_title(tv: str) -> str:
            value = let(f"filter({sm}, {k} -> {k}.parent = {tv}.id)",
                        lambda kids: f"CASE WHEN size({kids}) = 1 AND get({kids}, 0).kind IN ('text', 'raw') "
                                     f"THEN get({kids}, 0).text ELSE '' END")
            return f"CASE WHEN {tv} IS NOT NULL THEN array(named_struct('key', 'title', 'value', {value})) END"

        title = let(f"get(filter({sm}, {t} -> {t}.tag = 'title'), 0)", with_title)
        empty = "cast(array() as array<struct<key:string,value:string>>)"
        return f"map_from_entries(concat(coalesce({title}, {empty}), {entries}))"

    return let(small, build)
