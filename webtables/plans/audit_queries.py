"""Registered queries: audits, link graph, set operations, chat."""

from __future__ import annotations

from pyspark.sql import functions as F

from webtables.functions.urls import host, host_matches_rules
from webtables.operators import audits as G
from webtables.operators import chat as C
from webtables.operators import requests as R
from webtables.operators.parse import parse_pages
from webtables.plans.queries import _parsed, query
from webtables.sources import derived as D
from webtables.sources.tables import pages, read_table

SITES = ["example.com", "example.net", "example.org"]
RULES = ".example.org, example.net, spam-farm.example.org"


@query("g1_seo_audit")
def q_seo(spark, d):
    return G.seo_audit(_parsed(spark, d)).select(
        "page_id", "title_present", "title_length_ok", "single_h1", "heading_order", "image_alt",
        "internal_links", "https", "viewport", "passed", "checks", "score",
    )


@query("g2_link_audit")
def q_link_audit(spark, d):
    return G.link_audit(_parsed(spark, d), max_external=100)


# --- the audits over pages that hold their cases ----------------------------------

def _cases(spark, d):
    return parse_pages(D.audit_pages(spark, d), keep_html=False)


@query("g1_seo_audit_cases")
def q_seo_cases(spark, d):
    return G.seo_audit(_cases(spark, d)).drop("url")


@query("g2_link_audit_cases")
def q_link_audit_cases(spark, d):
    return G.link_audit(_cases(spark, d), max_external=0)


@query("g3_metadata_check_cases")
def q_meta_cases(spark, d):
    return G.metadata_check(_cases(spark, d)).drop("url")


@query("g4_accessibility_cases")
def q_a11y_cases(spark, d):
    return G.accessibility_check(_cases(spark, d))


@query("g6_page_profile_cases")
def q_profile_cases(spark, d):
    return G.page_profile(_cases(spark, d)).drop("url")


@query("g8_competitor_matrix_cases")
def q_matrix_cases(spark, d):
    m = G.competitor_matrix(G.page_profile(_cases(spark, d)), SITES[:2])
    for s in SITES[:2]:
        m = m.withColumnRenamed(s, s.replace(".", "_"))
    return m


@query("h4_page_metadata_cases")
def q_h4_cases(spark, d):
    from webtables.operators.content import page_metadata

    m = page_metadata("nodes")
    return _cases(spark, d).select("page_id", F.size(m).alias("n_keys"), m["description"].alias("description"), m["og:image"].alias("og_image"), m["twitter:card"].alias("card"))


@query("p12_selector_then_metadata_cases")
def q_p12_cases(spark, d):
    from webtables.operators.content import page_metadata
    from webtables.operators.selectors import selected_subtrees

    m = page_metadata(selected_subtrees("nodes", "article, head > meta[name^=twitter]"))
    return _cases(spark, d).select("page_id", F.size(m).alias("n_keys"), m["author"].alias("author"), m["twitter:title"].alias("twitter_title"))


@query("a15_linked_domains_cases")
def q_domains_cases(spark, d):
    own = pages(spark, d).select("page_id", F.col("url").alias("src_url"))
    links = G.link_rows(_cases(spark, d)).join(own, "page_id")
    return G.linked_domains(links.select(F.col("page_id").alias("src_page_id"), "src_url", F.col("url").alias("dst_url")))


@query("c2_answer_outcomes_cases")
def q_outcomes_cases(spark, d):
    """Errors of every class: the log's error texts replaced by those of the service."""
    k = F.col("k") % 4
    said = F.when(k == 0, "Rate limit exceeded: slow down").when(k == 1, "Bad request: no model").when(k == 2, "Answer service not available").otherwise(F.col("error"))
    log = D.request_log(spark, d).withColumn("error", F.when(F.col("error").isNotNull(), said))
    return log.groupBy(R.outcome_class(F.col("error")).alias("status"), "request_type").agg(F.count(F.lit(1)).alias("n"))


@query("j3_broken_links")
def q_broken(spark, d):
    return G.broken_links(D.graph_links(spark, d), pages(spark, d)).select("src_page_id", "dst_url", "reason")


@query("j7_orphan_pages")
def q_orphans(spark, d):
    return G.orphan_pages(pages(spark, d), D.graph_links(spark, d)).select("page_id")


@query("a15_linked_domains")
def q_domains(spark, d):
    return G.linked_domains(D.graph_links(spark, d), own=True)


@query("j6_host_rule_join")
def q_rules(spark, d):
    return G.match_host_rules(pages(spark, d).select("page_id", "url"), D.host_rules(spark)).select("page_id", "rule")


@query("p7_host_rule_filter")
def q_bypass(spark, d):
    return pages(spark, d).select("page_id", host_matches_rules(host(F.col("url")), RULES).alias("matched"))


@query("u1_merge_host_lists")
def q_merge(spark, d):
    a = pages(spark, d).select(host(F.col("url")).alias("host"))
    b = D.host_rules(spark).select(F.regexp_replace("rule", r"^\.", "").alias("host"))
    return G.merge_lists(a, b, "host")


@query("g3_metadata_coverage")
def q_meta_cov(spark, d):
    return G.metadata_coverage(G.metadata_check(_parsed(spark, d)))


@query("g4_accessibility")
def q_a11y(spark, d):
    return G.accessibility_check(_parsed(spark, d))


@query("g5_extract_documents")
def q_extract_docs(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    return G.extract_data(docs, "text", key="doc_id")


@query("g6_page_profile")
def q_profile(spark, d):
    return G.page_profile(_parsed(spark, d)).drop("url")


@query("g8_competitor_matrix")
def q_matrix(spark, d):
    m = G.competitor_matrix(G.page_profile(_parsed(spark, d)), SITES)
    for s in SITES:
        m = m.withColumnRenamed(s, s.replace(".", "_"))
    return m


@query("j8_compare_to_reference")
def q_compare(spark, d):
    return G.compare_to_reference(pages(spark, d))



def _url_list(spark, d):
    """The URL list of the comparison queries: the stored pages 0 to 9."""
    return pages(spark, d).where("page_id < 10").select("url", F.col("page_id").cast("int").alias("place"))


@query("j8_compare_list")
def q_compare_list(spark, d):
    return G.compare_list(pages(spark, d), _url_list(spark, d)).select("kind", "item", "n_pages", F.get("pages", 0).alias("first_place"), "on_all")


@query("g7_compare_pairs")
def q_compare_pairs(spark, d):
    return G.compare_pairs(pages(spark, d), _url_list(spark, d))


@query("g7_similar_pages")
def q_similar(spark, d):
    """Pages of one registrable domain with half of their words in common or more."""
    site = F.regexp_extract(host(F.col("url")), r"([^.]+\.[^.]+)$", 1)
    return G.similar_pages(G.page_features(_parsed(spark, d)), 0.5, group=site)[0].select("class_a", "class_b", "shared", "jaccard")


@query("l4_top_sources")
def q_top_sources(spark, d):
    cites = C.citation_table(D.answers(spark, d), pages(spark, d)).withColumnRenamed("conv_id", "topic")
    return G.top_sources(cites, k=3).select("topic", "host", "citations", "rank")


# --- chat -----------------------------------------------------------------------------

def _conv(spark, d):
    return read_table(spark, d, "conversations").select("conv_id", "turn", "role", "text")


@query("w2_prompt_preview")
def q_prompt(spark, d):
    return C.prompt_preview(_conv(spark, d))


@query("w3_last_user_message")
def q_last_user(spark, d):
    return C.last_user_message(_conv(spark, d))


@query("h13_answer_log_url")
def q_log_url(spark, d):
    return C.answer_urls(_conv(spark, d))


@query("a11_token_usage")
def q_tokens(spark, d):
    return C.token_usage(D.answers(spark, d))


@query("c1_citations")
def q_citations(spark, d):
    return C.citation_table(D.answers(spark, d), pages(spark, d)).select("conv_id", "turn", "rank", "url", "page_id")


@query("c2_answer_outcomes")
def q_outcomes(spark, d):
    log = C.classify_answers(D.request_log(spark, d))
    return log.groupBy("request_type", "status_class", "rate_limited").agg(F.count(F.lit(1)).alias("n"))



@query("s2_citation_positions")
def q_positions(spark, d):
    from webtables.sources.tables import url_array_positions

    a = D.answers(spark, d).select("conv_id", "turn", "citations")
    return url_array_positions(a, "citations")


# --- the same link-graph jobs over the links extracted from the crawl ------------

def _crawl_links(spark, d):
    own = pages(spark, d).select("page_id", F.col("url").alias("src_url"))
    return G.link_rows(_parsed(spark, d)).join(own, "page_id").select(F.col("page_id").alias("src_page_id"), "src_url", F.col("url").alias("dst_url"))


@query("j3_broken_links_crawl")
def q_broken_crawl(spark, d):
    b = G.broken_links(_crawl_links(spark, d), pages(spark, d))
    return b.groupBy("src_page_id", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("j7_orphan_pages_crawl")
def q_orphans_crawl(spark, d):
    return G.orphan_pages(pages(spark, d), _crawl_links(spark, d)).select("page_id")


@query("a15_linked_domains_crawl")
def q_domains_crawl(spark, d):
    return G.linked_domains(_crawl_links(spark, d), own=True)


@query("g5_extract_pages")
def q_extract_pages(spark, d):
    from webtables.operators.content import page_text

    text = _parsed(spark, d).select("page_id", page_text("nodes").alias("text"))
    return G.extract_data(text, "text", key="page_id")
