"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver's tables (or views Spark derives from them) in
full; names carry the SURVEY inventory id they implement.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtables.functions.urls import is_http_url
from webtables.operators import pages as P
from webtables.operators.content import DEFAULT_TEXT_STRIP
from webtables.operators.parse import parse_pages
from webtables.schema import FETCH_META
from webtables.sources import derived as D
from webtables.sources.tables import pages

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn

    return deco


def _parsed(spark, sf_dir, *cols, keep_html: bool = False):
    return parse_pages(pages(spark, sf_dir).select("page_id", "url", "html", *cols), keep_html=keep_html)


# --- pages: scan, text, links, metadata ------------------------------------

@query("s1_links_by_host")
def q_links_by_host(spark, d):
    return P.links_by_host(pages(spark, d))


@query("s1_page_scan")
def q_page_scan(spark, d):
    return P.scan_pages(D.fetch_results(spark, d)).select(
        "page_id", "url", F.length("content").alias("content_chars"), "status_code", "content_type",
        "metadata.elapsed_ms", "metadata.attempts", "metadata.final_url", F.col("metadata.headers")["x-k"].alias("x_k"),
    )


def _records(spark, d):
    """The fetch records of the pages, written as JSON lines to the shared folder."""
    from webtables.session import checkpoint_dir
    from webtables.sources import fetches

    path = f"{checkpoint_dir(spark).rstrip('/')}/fetches-{uuid.uuid4().hex}"
    fetches.write_fetches(D.fetch_results(spark, d), path)
    return path


@query("s1_fetch_records")
def q_fetch_records(spark, d):
    """Saved fetch records read back and scanned: metadata out of its VARIANT."""
    from webtables.sources import fetches

    got = P.scan_pages(fetches.fetched_pages(spark, _records(spark, d)))
    return got.select("page_id", "url", F.length("content").alias("content_chars"), "status_code", "content_type",
                      "metadata.elapsed_ms", "metadata.attempts", "metadata.final_url", F.col("metadata.headers")["x-k"].alias("x_k"))


@query("p4_clean_metadata_records")
def q_clean_records(spark, d):
    from webtables.sources import fetches

    got = fetches.fetched_pages(spark, _records(spark, d))
    m = P.clean_metadata(P.full_metadata(F.col("metadata"), FETCH_META.fieldNames()), include_headers=False)
    return got.select("page_id", F.to_json(m).alias("json"))


@query("p1_scheme_filter")
def q_scheme(spark, d):
    return pages(spark, d).select("page_id", is_http_url("url").alias("supported"))


@query("h1_page_text")
def q_text(spark, d):
    return _parsed(spark, d).select("page_id", P.page_text("nodes").alias("text"))


@query("h1_text_strip_nav")
def q_text_strip(spark, d):
    return _parsed(spark, d).select("page_id", P.page_text("nodes", ["script", "style", "nav"]).alias("text"))


@query("h3_links")
def q_links(spark, d):
    return _parsed(spark, d).select("page_id", F.posexplode(P.page_links("nodes", "url"))).select(
        "page_id", "pos", "col.url", "col.text", "col.title"
    )


@query("a9_links_per_page")
def q_links_per_page(spark, d):
    return _parsed(spark, d).select("page_id", F.size(P.page_links("nodes", "url")).alias("n_links"))


@query("h4_page_metadata")
def q_meta(spark, d):
    m = P.page_metadata("nodes")
    return _parsed(spark, d).select(
        "page_id", m["title"].alias("title"), F.size(m).alias("n_keys")
    )


@query("a14_content_reduction")
def q_reduction(spark, d):
    src = pages(spark, d).select("page_id", "url", "html", F.length("html").alias("html_chars"))
    t = parse_pages(src, keep_html=False).select("page_id", "html_chars", F.length(P.page_text("nodes")).alias("text_chars"))
    return t.select(
        "page_id", "html_chars", "text_chars",
        F.round(100 * (1 - F.col("text_chars") / F.col("html_chars")), 2).alias("reduction_pct"),
    )


@query("m3_batch_text")
def q_batch_text(spark, d):
    r = P.batch_convert(pages(spark, d), "text")
    return r.select("page_id", "final_url", "success", "error", F.col("content").alias("text"),
                    F.col("metadata.page_metadata")["title"].alias("title"))


@query("m4_batch_links")
def q_batch_links(spark, d):
    r = P.batch_convert(pages(spark, d), "links")
    return r.select("page_id", "success", F.size("content").alias("count"),
                    F.get("content", 0)["url"].alias("first_url"))


@query("a1_batch_totals")
def q_totals(spark, d):
    return P.batch_totals(P.batch_convert(pages(spark, d), "text"))


def all_queries() -> dict[str, Query]:
    # importing the modules registers their queries
    from webtables.plans import audit_queries, request_queries, stream_queries  # noqa: F401

    return dict(REGISTRY)


# --- selectors ------------------------------------------------------------------

def _sel(spark, d, sel):
    from webtables.operators.selectors import filter_by_selector

    p = _parsed(spark, d, keep_html=True)
    return p.select("page_id", filter_by_selector("nodes", "html", sel).alias("r"))


@query("p2_select_nav_links")
def q_sel_nav(spark, d):
    return _sel(spark, d, "nav a").select("page_id", "r.content", F.col("r.count").alias("elements_matched"))


@query("p2_select_class")
def q_sel_class(spark, d):
    return _sel(spark, d, "div.ad").select("page_id", "r.content", F.col("r.count").alias("elements_matched"))


@query("a10_elements_matched")
def q_sel_count(spark, d):
    return _sel(spark, d, "article p, h1").select("page_id", F.col("r.count").alias("elements_matched"))


@query("j4_descendant_match")
def q_desc(spark, d):
    return _sel(spark, d, "body li a").select("page_id", F.col("r.count").alias("elements_matched"))


@query("j5_child_sibling_match")
def q_child(spark, d):
    from webtables.operators.selectors import match_nodes

    p = _parsed(spark, d)
    return p.select(
        "page_id",
        F.size(match_nodes("nodes", "ul > li")).alias("child"),
        F.size(match_nodes("nodes", "li + li")).alias("adjacent"),
        F.size(match_nodes("nodes", "li ~ li")).alias("general"),
    )


@query("w5_sibling_positions")
def q_typesib(spark, d):
    from webtables.operators.parse import explode_nodes

    n = explode_nodes(_parsed(spark, d))
    return n.where(F.col("tag") == "li").select("page_id", "type_sib", "sib")


def _batch(spark, d, mode, selector=None, **named):
    """A batch over the URL list (all pages, the last first, and two URLs that have no
    stored fetch) with what was fetched for each."""
    got = D.fetch_results(spark, d).withColumn("n_pages", pages(spark, d).agg(F.count(F.lit(1))).scalar())
    # the list as it is asked for: positions count down the pages
    urls = got.select("page_id", (F.col("n_pages") - 1 - F.col("page_id")).alias("position"), "url")
    lost = urls.where("page_id < 2").select(F.lit(None).cast("long").alias("page_id"), (F.col("position") + 2).alias("position"),
                                            F.when(F.col("page_id") == 0, F.lit("https://lost.example.com/")).otherwise(F.lit("ftp://old.example.com/")).alias("url"))
    known = urls.join(got.drop("url", "n_pages"), "page_id")
    rows = known.unionByName(P.requested(lost.select("position", "url"), got.drop("n_pages")), allowMissingColumns=True)
    return P.batch_convert(rows, mode, css_selector=selector, **named)


@query("m1_batch_html")
def q_m1_whole(spark, d):
    r = _batch(spark, d, "html", include_headers=True)
    return r.select("position", "url", "success", "error", "status_code", "content_type", F.length("content").alias("chars"),
                    F.col("metadata.headers")["x-k"].alias("x_k"), "metadata.attempts", "metadata.retries", "metadata.from_cache", "final_url")


@query("m1_batch_html_selector")
def q_m1(spark, d):
    r = _batch(spark, d, "html", "nav a")
    return r.select("position", "success", "error", "content", "metadata.elements_matched", "metadata.css_selector_applied",
                    F.col("metadata.headers").isNull().alias("no_headers"), "metadata.proxy_used", F.col("metadata.proxy_config")["country"].alias("country"))


@query("m2_batch_markdown_selector")
def q_m2_selector(spark, d):
    r = _batch(spark, d, "markdown", "h1, nav li")
    md = F.col("content")
    return r.select("position", "success", F.size(F.regexp_extract_all(md, F.lit("(?m)^# "), 0)).alias("h1_lines"),
                    (F.size(F.split(md, r"\]\(")) - 1).alias("link_refs"), "metadata.elements_matched")


@query("m3_batch_text_selector")
def q_m3_selector(spark, d):
    r = _batch(spark, d, "text", "article, .content")
    return r.select("position", "final_url", "success", "error", F.col("content").alias("text"), "metadata.rendered_js",
                    F.size("metadata.page_metadata").alias("n_keys"))


@query("m4_batch_links_selector")
def q_m4_selector(spark, d):
    r = _batch(spark, d, "links", "li:nth-last-child(-n+2)")
    return r.select("position", "success", F.size("content").alias("count"), F.get("content", 0)["url"].alias("first_url"))


@query("p13_invalid_selector")
def q_p13(spark, d):
    return _batch(spark, d, "text", "nav >").select("position", "success", "error", F.col("content").isNull().alias("no_content"))


@query("l2_results_in_order")
def q_l2(spark, d):
    """The results that succeeded, sorted as they were asked for."""
    r = P.in_order(_batch(spark, d, "links")).select("position", "url", "success")
    return r.where("success").select("position", "url")


@query("a1_totals_while_writing")
def q_a1_observed(spark, d):
    from webtables.session import checkpoint_dir

    path = f"{checkpoint_dir(spark).rstrip('/')}/batch-{uuid.uuid4().hex}"
    totals = P.write_batch(_batch(spark, d, "text"), path)
    written = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("written"))
    return written.select("written", *[F.lit(totals[k]).cast("long").alias(k) for k in ("total", "successful", "failed")])


@query("p5_headers")
def q_p5(spark, d):
    got = D.fetch_results(spark, d)
    m = P.full_metadata(F.col("metadata"), got.schema["metadata"].dataType.fieldNames())
    kept, cut = P.clean_metadata(m, include_headers=True), P.clean_metadata(m)
    return got.select("page_id", F.to_json(kept["headers"]).alias("headers"), P.clean_metadata(m, include_headers=False)["headers"].isNull().alias("dropped"), cut["attempts"].alias("attempts"))


@query("h17_dict_merge")
def q_h17(spark, d):
    got = D.fetch_results(spark, d)
    more = F.create_map(F.lit("x-k"), F.concat(F.lit("page "), F.col("page_id").cast("string")), F.lit("etag"), F.col("url"))
    m = P.merge_maps(F.col("metadata.headers"), F.when(F.col("page_id") % 4 != 0, more))
    return got.select("page_id", F.size(m).alias("n"), m["x-k"].alias("x_k"), m["etag"].alias("etag"), m["content-type"].alias("kind"))


@query("g9_main_content_text")
def q_main(spark, d):
    from webtables.operators.selectors import selected_subtrees

    p = _parsed(spark, d)
    return p.select("page_id", P.page_text(selected_subtrees("nodes", "article, main, .content", DEFAULT_TEXT_STRIP), []).alias("text"))


@query("m2_batch_markdown")
def q_m2(spark, d):
    r = P.batch_convert(pages(spark, d), "markdown", strip_tags=["script", "style", "noscript"])
    return r.select("page_id", "success", F.length("content").alias("markdown_chars"),
                    F.col("content").contains("# ").alias("has_heading"))


@query("p12_selector_then_metadata")
def q_p12(spark, d):
    from webtables.operators.selectors import selected_subtrees

    p = _parsed(spark, d)
    return p.select("page_id", F.size(P.page_metadata(selected_subtrees("nodes", "article"))).alias("n_keys"))


@query("m2_markdown_structure")
def q_m2_structure(spark, d):
    r = P.batch_convert(pages(spark, d), "markdown", strip_tags=["script", "style", "noscript"])
    md = F.col("content")
    return r.select(
        "page_id",
        "success",
        F.size(F.regexp_extract_all(md, F.lit("(?m)^# "), 0)).alias("h1_lines"),
        (F.size(F.split(md, r"\]\(")) - 1).alias("link_refs"),
    )
