"""Page-level jobs over parsed pages: scan shapes, batch conversions and
totals (S1, P1, P4-P6, P9, H17, A1, A9, A14, M1-M4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from webtables.functions.text import _c
from webtables.functions.urls import host, is_http_url
from webtables.operators.content import DEFAULT_TEXT_STRIP, content_reduction, page_links, page_metadata, page_text
from webtables.operators.markdown import selected_markdown
from webtables.operators.parse import parse_pages
from webtables.operators.selectors import compile_selector, match_nodes, outer_html, selected_subtrees
from webtables.schema import FETCH_META


# Error text of a URL no provider supports.
UNSUPPORTED_URL = "ValueError: No provider supports URL: %s"


def _or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def full_metadata(meta: Column | None, kept: list[str]) -> Column:
    """A struct with all fields of ``schema.FETCH_META`` from one that has the fields
    ``kept`` of them (others null)."""
    return F.struct(*[
        (meta[f.name] if meta is not None and f.name in kept else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in FETCH_META.fields
    ])


def scan_pages(pages: DataFrame) -> DataFrame:
    """Fetched pages as ``(page_id, url, content, status_code, content_type, metadata)``.

    Any frame with ``page_id, url, html`` is a source (X3); ``status_code``,
    ``content_type`` and ``metadata`` (any of the fields of ``schema.FETCH_META``) are read
    where it has them and null where not."""
    meta = F.col("metadata") if "metadata" in pages.columns else None
    kept = pages.schema["metadata"].dataType.fieldNames() if meta is not None else []
    return pages.select(
        "page_id",
        "url",
        F.col("html").alias("content"),
        _or_null(pages, "status_code", "int").alias("status_code"),
        _or_null(pages, "content_type", "string").alias("content_type"),
        full_metadata(meta, kept).alias("metadata"),
    )


def links_by_host(pages: DataFrame) -> DataFrame:
    """Flagship: pages and links per host (P1 -> X1 -> H3/H5 -> agg)."""
    ok = pages.select("url", "html").where(is_http_url("url"))
    # counting needs no URL resolution: count the <a href> elements (H3's rows)
    n_links = F.size(F.filter("nodes", lambda n: (n["tag"] == "a") & F.map_contains_key(n["attrs"], "href")))
    parsed = parse_pages(ok, keep_html=False).select("url", n_links.alias("n_links"))
    return parsed.groupBy(host("url").alias("host")).agg(
        F.count(F.lit(1)).alias("pages"), F.sum("n_links").cast("long").alias("links")
    )


def clean_metadata(meta: Column, css_selector: str | None = None, elements_matched=None,
                   include_headers: bool = True) -> Column:
    """Sparse metadata. Fields that must vanish are null, and
    ``to_json`` omits null fields."""
    m = meta
    return F.struct(
        m["elapsed_ms"].alias("elapsed_ms"),
        F.when(F.coalesce(m["attempts"], F.lit(1)) > 1, m["attempts"]).alias("attempts"),
        F.when(F.coalesce(m["retries"], F.lit(0)) > 0, m["retries"]).alias("retries"),
        F.when(F.coalesce(m["from_cache"], F.lit(False)), F.lit(True)).alias("from_cache"),
        F.when(F.coalesce(m["proxy_used"], F.lit(False)), F.lit(True)).alias("proxy_used"),
        F.when(F.coalesce(m["proxy_used"], F.lit(False)), m["proxy_config"]).alias("proxy_config"),
        (F.lit(css_selector) if css_selector else F.lit(None).cast("string")).alias("css_selector_applied"),
        (
            (elements_matched if isinstance(elements_matched, Column) else F.lit(elements_matched)).cast("int")
            if css_selector and elements_matched is not None
            else F.lit(None).cast("int")
        ).alias("elements_matched"),
        m["page_metadata"].alias("page_metadata"),
        (m["headers"] if include_headers else F.lit(None).cast("map<string,string>")).alias("headers"),
        F.when(F.coalesce(m["rendered_js"], F.lit(False)), F.lit(True)).alias("rendered_js"),
    )


def preview(content, limit: int = 5000) -> Column:
    """First ``limit`` characters; ``content_truncated`` and
    ``full_content_length`` only when longer."""
    c = _c(content)
    longer = F.length(c) > limit
    return F.struct(
        F.substring(c, 1, limit).alias("content"),
        F.when(longer, F.lit(True)).alias("content_truncated"),
        F.when(longer, F.length(c)).alias("full_content_length"),
    )


def merge_structs(left: Column, **right: Column) -> Column:
    """H17 for structs: the fields of ``left``, those of ``right`` added or replaced."""
    for name, value in right.items():
        left = left.withField(name, value)
    return left


def merge_maps(left, right) -> Column:
    """H17 for maps: the entries of both, the right one's value where both have a key,
    whatever the session's policy for repeated keys. A null map is empty; null if both are."""
    left, right = _c(left), _c(right)
    both = F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)
    return F.coalesce(both, right, left)


def batch_convert(pages: DataFrame, mode: str, strip_tags: list[str] | None = None,
                  include_headers: bool = False, css_selector: str | None = None) -> DataFrame:
    """M1-M4: one result row per input row; ``mode`` is ``html``, ``markdown``, ``text`` or
    ``links``. ``pages`` needs ``page_id, url, html``; ``status_code``, ``content_type``,
    ``metadata``, ``final_url``, ``error`` (of a fetch that failed) and ``position`` (in
    the input, for :func:`in_order`) are used where it has them.

    With ``css_selector`` the matches stand for the page, in text, links, metadata and
    markdown too, and ``elements_matched`` counts them (0: empty content). A row fails
    alone, with ``error = "{Type}: {message}"``, for an unsupported URL, a failed fetch, a
    page that does not parse or an invalid selector (P6, P13)."""
    if mode not in ("html", "markdown", "text", "links"):
        raise ValueError(f"unknown mode {mode!r}")
    invalid, css_selector = None, css_selector or None
    if css_selector:
        try:
            compile_selector(css_selector)
        except ValueError as e:
            invalid, css_selector = f"ValueError: {e}", None
    # rows that fail before any work are not parsed
    ok = is_http_url("url")
    failed = F.when(~ok, F.format_string(UNSUPPORTED_URL, F.col("url"))).otherwise(_or_null(pages, "error", "string"))
    if invalid:
        failed = F.coalesce(failed, F.lit(invalid))
    scanned = scan_pages(pages).drop("content").columns
    meta = F.col("metadata") if "metadata" in pages.columns else None
    kept = pages.schema["metadata"].dataType.fieldNames() if meta is not None else []
    full = full_metadata(meta, kept)
    rows = pages.select(
        *[c for c in ("position",) if c in pages.columns], "page_id", "url",
        F.coalesce(_or_null(pages, "final_url", "string"), full["final_url"], F.col("url")).alias("final_url"),
        *[_or_null(pages, c, k).alias(c) for c, k in (("status_code", "int"), ("content_type", "string")) if c in scanned],
        full.alias("metadata"), failed.alias("_failed"), F.when(failed.isNull(), F.col("html")).alias("html"),
    )
    whole = css_selector is None
    written = mode == "markdown" and whole
    parsed = parse_pages(rows, keep_html=mode == "html", markdown_strip=(strip_tags or []) if written else None)
    error = F.coalesce("_failed", "parse_error")
    strip = DEFAULT_TEXT_STRIP if strip_tags is None else strip_tags
    matched, part = None, "nodes"
    if not whole:
        matched = F.size(match_nodes("nodes", css_selector))
        part = selected_subtrees("nodes", css_selector)
    if mode == "text":
        content = page_text(part, strip_tags) if whole else page_text(selected_subtrees("nodes", css_selector, strip), [])
    elif mode == "markdown":
        content = F.col("markdown") if written else selected_markdown(F.col("nodes"), css_selector, strip_tags)
    elif mode == "links":
        content = page_links("nodes", "final_url", within=None if whole else part)
    else:
        content = F.col("html") if whole else F.array_join(outer_html("html", match_nodes("nodes", css_selector)), "\n")
    meta = F.col("metadata")
    if mode in ("text", "markdown"):
        meta = merge_structs(meta, page_metadata=page_metadata(part))
    keep = lambda c, name: F.when(error.isNull(), c).alias(name)
    out = parsed.select(
        *[c for c in ("position",) if c in pages.columns], "page_id", "url",
        keep(F.col("final_url"), "final_url"),
        keep(content, "content"),
        *[keep(F.col(c), c) for c in ("status_code", "content_type")],
        keep(clean_metadata(meta, css_selector, matched, include_headers), "metadata"),
        error.alias("error"),
    )
    return out.withColumn("success", F.col("error").isNull())


def requested(urls: DataFrame, fetched: DataFrame) -> DataFrame:
    """L2: the rows of a batch: ``urls`` (position, url; a URL may come twice) with what was
    fetched for each. A URL without a stored fetch is a row with an error."""
    known = fetched.withColumn("_known", F.lit(True))
    rows = urls.select("position", "url").join(known, "url", "left")
    missing = F.when(F.col("_known").isNull() & is_http_url("url"), F.concat(F.lit("LookupError: no stored fetch of "), "url"))
    error = F.coalesce(F.col("error"), missing) if "error" in fetched.columns else missing
    return rows.withColumn("error", error).drop("_known")


def in_order(results: DataFrame) -> DataFrame:
    """L2: results in the order of the input (``position``, then page)."""
    return results.orderBy("position", "page_id")


def write_batch(results: DataFrame, path: str) -> dict[str, int]:
    """M1-M4 with A1 in one pass: write the results and return their totals, observed while
    they are written, so each page is parsed once."""
    seen = Observation()
    results.observe(
        seen,
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.count_if("success"), F.lit(0)).alias("successful"),
        F.coalesce(F.count_if(~F.col("success")), F.lit(0)).alias("failed"),
    ).write.mode("overwrite").parquet(path)
    return seen.get


def batch_totals(results: DataFrame) -> DataFrame:
    """A1: ``total, successful, failed``; an empty batch gives zeros."""
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum(F.col("success").cast("long")), F.lit(0)).alias("successful"),
        F.coalesce(F.sum((~F.col("success")).cast("long")), F.lit(0)).alias("failed"),
    )


__all__ = [
    "scan_pages", "links_by_host", "clean_metadata", "preview", "batch_convert",
    "batch_totals", "requested", "in_order", "write_batch", "merge_maps", "merge_structs", "content_reduction", "page_links", "page_metadata", "page_text", "host",
]
