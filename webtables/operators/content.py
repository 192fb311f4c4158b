"""Page content as columns over the node array: text (H1), links (H3, A9),
metadata (H4), content reduction (A14). All are per-row expressions: no
shuffle, no join, work linear in the page size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webtables.functions.html import tag_masks
from webtables.functions.text import _c, let, ustrip
from webtables.functions.urls import resolve_parts, url_parts
from webtables.operators.parse import has_ancestor, strip_subtrees, subtree

# Tags stripped by default before text extraction.
DEFAULT_TEXT_STRIP = ["script", "style", "meta", "link", "noscript"]


def _is_text(n: Column) -> Column:
    return n["kind"] == "text"


def text_lines(nodes, strip_tags: list[str] | None = None) -> Column:
    """Non-blank, stripped lines of the page text, in document order."""
    tags = DEFAULT_TEXT_STRIP if strip_tags is None else strip_tags
    kept = F.filter(strip_subtrees(_c(nodes), tags), _is_text)
    lines = F.flatten(F.transform(kept, lambda n: F.split(n["text"], "\n")))
    return F.filter(F.transform(lines, ustrip), lambda s: s != "")


def page_text(nodes, strip_tags: list[str] | None = None) -> Column:
    """H1: html_to_text of a whole page. ``None`` strips the default tags, ``[]`` nothing
    (for parts of a page, which ``selected_subtrees`` strips)."""
    tags = DEFAULT_TEXT_STRIP if strip_tags is None else strip_tags
    if isinstance(nodes, str) and tag_masks([t.lower() for t in tags]) is not None:
        from webtables.functions import sqltext

        return F.expr(sqltext.page_text(sqltext.name(nodes), tags))
    return F.array_join(text_lines(nodes, strip_tags), "\n")


def node_text(nodes, n: Column, sep: str = "") -> Column:
    """Stripped text pieces under node ``n`` joined by ``sep`` (get_text(strip=True))."""
    pieces = F.transform(F.filter(subtree(_c(nodes), n), _is_text), lambda t: ustrip(t["text"]))
    return F.array_join(F.filter(pieces, lambda s: s != ""), sep)


def page_links(nodes, base_url=None, within=None) -> Column:
    """H3: every ``<a href>`` in document order, duplicates kept, as
    ``array<struct<url, text, title>>``; ``url`` resolved against
    ``base_url`` when it is non-empty (H5). ``within`` (a filtered node
    array, e.g. selector matches) limits the anchors; text always comes
    from the complete ``nodes`` array."""
    if isinstance(nodes, str) and (base_url is None or isinstance(base_url, str)) and within is None:
        from webtables.functions import sqltext as urlsql  # one SQL text, not a Column tree

        return F.expr(urlsql.page_links(urlsql.name(nodes), None if base_url is None else urlsql.name(base_url)))
    nodes = _c(nodes)
    src = nodes if within is None else _c(within)
    anchors = F.filter(
        src, lambda n: (n["tag"] == "a") & F.map_contains_key(n["attrs"], "href")
    )
    base = F.lit(None).cast("string") if base_url is None else _c(base_url)

    def with_base(bp: Column) -> Column:
        def one(a: Column) -> Column:
            href = a["attrs"]["href"]
            return F.struct(
                resolve_parts(bp, base, href).alias("url"),
                node_text(nodes, a).alias("text"),
                F.coalesce(a["attrs"]["title"], F.lit("")).alias("title"),
            )

        return F.transform(anchors, one)

    # the base URL is parsed once per page, not once per link
    return let(url_parts(base), with_base)


def _title_entry(small: Column) -> Column:
    """``small`` holds the title/meta elements and the title's text children
    only (see ``page_metadata``)."""

    def with_title(title: Column) -> Column:
        kids = F.filter(small, lambda n: n["parent"] == title["id"])

        def value_of(k: Column) -> Column:
            only = F.get(k, 0)
            return F.when((F.size(k) == 1) & only["kind"].isin("text", "raw"), only["text"]).otherwise(F.lit(""))

        return F.when(
            title.isNotNull(),
            F.array(F.struct(F.lit("title").alias("key"), let(kids, value_of).alias("value"))),
        )

    return let(F.get(F.filter(small, lambda n: n["tag"] == "title"), 0), with_title)


def page_metadata(nodes) -> Column:
    """H4: ``map<string,string>``: title (first title's single string or
    ''), then every meta with (name else property) and content both
    non-empty; later keys overwrite earlier ones (needs LAST_WIN)."""
    if isinstance(nodes, str):
        from webtables.functions import sqltext

        return F.expr(sqltext.page_metadata(sqltext.name(nodes)))
    nodes = _c(nodes)
    # one pass over the page keeps what metadata needs: title and meta
    # elements and the direct children of titles (by parent id, so this also
    # works on filtered or concatenated arrays)
    small = F.filter(
        nodes,
        lambda n: n["tag"].isin("title", "meta")
        | (n["tag"].isNull() & has_ancestor(n, ["title"])),
    )

    def build(sm: Column) -> Column:
        metas = F.filter(sm, lambda n: n["tag"] == "meta")
        entries = F.transform(
            metas,
            lambda m: F.struct(
                F.coalesce(F.nullif(m["attrs"]["name"], F.lit("")), m["attrs"]["property"]).alias("key"),
                m["attrs"]["content"].alias("value"),
            ),
        )
        entries = F.filter(
            entries,
            lambda e: (F.coalesce(e["key"], F.lit("")) != "") & (F.coalesce(e["value"], F.lit("")) != ""),
        )
        empty = F.array().cast("array<struct<key:string,value:string>>")
        return F.map_from_entries(F.concat(F.coalesce(_title_entry(sm), empty), entries))

    return let(small, build)


def content_reduction(output, html) -> Column:
    """``1 - len(output)/len(html)`` (null for an empty page)."""
    return F.when(F.length(_c(html)) > 0, 1 - F.length(_c(output)) / F.length(_c(html)))
