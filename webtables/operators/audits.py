"""Site audits (G1-G9), link-graph jobs (J3, J6, J7, J8, A15), set
operations (U1, U2) and top-k sources (L4).

Per-page checks are expressions over the node array, so an audit of a crawl
is one narrow stage. Cross-page jobs (broken links, orphans, domains, rule
matches) are equi-joins on a normalised URL or host suffix, never theta or
cross joins; page comparison pairs each page with one reference page, so
the number of pairs is linear in the pages.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webtables.functions.overlap import overlapping
from webtables.functions.text import _c
from webtables.functions.urls import host, host_suffixes, scheme
from webtables.operators.content import node_text, page_links, page_metadata, text_lines
from webtables.operators.parse import has_ancestor, parse_pages
from webtables.session import checkpoint_dir

# SEO length windows (characters), link-text phrases that say
# nothing, landmark tags, and the profile tag groups.
TITLE_LEN = (50, 60)
DESCRIPTION_LEN = (150, 160)
GENERIC_LINK_TEXT = ["click here", "here", "read more", "more", "link", "this", "click"]
LANDMARKS = ["nav", "main", "footer"]
PROFILE_GROUPS = {
    "main_content": ["p", "h1", "h2", "h3", "h4", "h5", "h6", "article", "main", "section", "blockquote", "pre"],
    "navigation": ["nav", "a", "menu"],
    "metadata": ["meta", "title", "link", "base"],
    "media": ["img", "video", "audio", "picture", "source", "iframe", "svg", "canvas"],
    "forms": ["form", "input", "select", "textarea", "button", "label", "option"],
}
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
NO_LABEL_TYPES = ["hidden", "submit", "button", "image", "reset"]
# Extraction patterns (contact, pricing, dates, numbers).
EXTRACT_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])|\+?[0-9][0-9 ().-]{7,}[0-9]",
    "price": r"[$€£] ?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:[.,][0-9]{1,2})?",
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}",
    "number": r"(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:[.,][0-9]+)?%?",
}
# What a match of a pattern must not look like: a date is no phone number. The phone
# pattern takes a date by itself, so that a number after it is a match of its own.
EXTRACT_EXCEPT = {"phone": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"}


def _exists(arr: Column, f) -> Column:
    """Two-valued ``exists``: a null test counts as false."""
    return F.coalesce(F.exists(arr, lambda x: F.coalesce(f(x), F.lit(False))), F.lit(False))


def _elements(nodes: Column, tags: list[str]) -> Column:
    return F.filter(nodes, lambda n: n["tag"].isin(*tags))


def _meta(nodes: Column) -> Column:
    return page_metadata(nodes)


def _has_rel(nodes: Column, rel: str) -> Column:
    return _exists(
        nodes,
        lambda n: (n["tag"] == "link")
        & F.coalesce(F.array_contains(F.split(F.lower(n["attrs"]["rel"]), r"[ \t\n\r\f]+"), rel), F.lit(False)),
    )


def heading_levels(nodes) -> Column:
    return F.transform(_elements(_c(nodes), HEADINGS), lambda h: F.substring(h["tag"], 2, 1).cast("int"))


def heading_skips(levels) -> Column:
    """Number of places where the heading level rises by more than one
    (``levels`` is a column of heading levels, see ``heading_levels``)."""
    lv = _c(levels)
    return F.size(
        F.filter(
            F.sequence(F.lit(1), F.greatest(F.size(lv) - 1, F.lit(0))),
            lambda i: (F.size(lv) > 1) & (F.get(lv, i) - F.get(lv, i - 1) > 1),
        )
    )


def seo_audit(parsed: DataFrame) -> DataFrame:
    """G1: one row per page of boolean checks and ``score = passed/checks*100``
    (equal weights: the checklist gives none)."""
    # heavy arrays are computed once in their own projection, then referenced
    nodes = F.col("nodes")
    parsed = parsed.select(
        "page_id", "url", "nodes",
        _meta(nodes).alias("_meta"),
        page_links("nodes", "url").alias("_links"),
        heading_levels(nodes).alias("_lv"),
        host(F.col("url")).alias("_host"),
    )
    meta, links, lv, page_host = F.col("_meta"), F.col("_links"), F.col("_lv"), F.col("_host")
    title = F.coalesce(meta["title"], F.lit(""))
    desc = F.coalesce(meta["description"], F.lit(""))
    imgs = _elements(nodes, ["img"])
    checks = {
        "title_present": title != "",
        "title_length_ok": F.length(title).between(*TITLE_LEN),
        "description_present": desc != "",
        "description_length_ok": F.length(desc).between(*DESCRIPTION_LEN),
        "canonical": _has_rel(nodes, "canonical"),
        "robots": F.coalesce(meta["robots"], F.lit("")) != "",
        "og_title": F.map_contains_key(meta, "og:title"),
        "og_description": F.map_contains_key(meta, "og:description"),
        "og_image": F.map_contains_key(meta, "og:image"),
        "twitter_card": F.map_contains_key(meta, "twitter:card"),
        "twitter_title": F.map_contains_key(meta, "twitter:title"),
        "twitter_description": F.map_contains_key(meta, "twitter:description"),
        "single_h1": F.size(_elements(nodes, ["h1"])) == 1,
        "heading_order": (F.size(lv) == 0) | ((F.get(lv, 0) == 1) & (heading_skips(lv) == 0)),
        "image_alt": F.forall(imgs, lambda i: F.coalesce(i["attrs"]["alt"], F.lit("")) != ""),
        "internal_links": _exists(links, lambda link: host(link["url"]) == page_host),
        "https": scheme(F.col("url")) == "https",
        "viewport": F.map_contains_key(meta, "viewport"),
    }
    cols = [F.coalesce(v, F.lit(False)).alias(k) for k, v in checks.items()]
    out = parsed.select("page_id", "url", *cols)
    passed = sum(F.col(k).cast("int") for k in checks)
    return out.withColumn("passed", passed).withColumn("checks", F.lit(len(checks))).withColumn(
        "score", F.round(F.lit(100.0) * F.col("passed") / F.col("checks"), 2)
    )


def link_rows(parsed: DataFrame) -> DataFrame:
    """Links as a table: ``page_id, pos, url, text, title, rel, internal``."""
    nodes = F.col("nodes")
    anchors = F.filter(nodes, lambda n: (n["tag"] == "a") & F.map_contains_key(n["attrs"], "href"))
    rels = F.transform(anchors, lambda a: F.coalesce(F.lower(a["attrs"]["rel"]), F.lit("")))
    z = F.arrays_zip(page_links("nodes", "url").alias("l"), rels.alias("r"))
    rows = parsed.select("page_id", "url", F.posexplode(z).alias("pos", "z"))
    return rows.select(
        "page_id", "pos",
        F.col("z.l.url").alias("url"), F.col("z.l.text").alias("text"), F.col("z.l.title").alias("title"),
        F.col("z.r").alias("rel"),
        (host(F.col("z.l.url")) == host(F.col("url"))).alias("internal"),
    )


def link_audit(parsed: DataFrame, max_external: int = 100) -> DataFrame:
    """G2 per page: internal/external counts, links without text, nofollow
    links, and the excess-external flag (threshold is a parameter)."""
    nodes = F.col("nodes")
    parsed = parsed.select("page_id", "nodes", page_links("nodes", "url").alias("_links"),
                           host(F.col("url")).alias("_host"))
    anchors = F.filter(nodes, lambda n: (n["tag"] == "a") & F.map_contains_key(n["attrs"], "href"))
    links, ph = F.col("_links"), F.col("_host")
    web = F.size(F.filter(links, lambda l: is_http_link(l["url"])))
    internal = F.size(F.filter(links, lambda l: is_http_link(l["url"]) & (host(l["url"]) == ph)))
    nofollow = F.size(F.filter(
        anchors, lambda a: F.coalesce(F.array_contains(F.split(F.lower(a["attrs"]["rel"]), r"[ \t\n\r\f]+"), "nofollow"), F.lit(False))
    ))
    parsed = parsed.withColumn("_internal", internal)
    internal = F.col("_internal")
    out = parsed.select(
        "page_id",
        F.size(links).alias("links"),
        internal.alias("internal"),
        (web - internal).alias("external"),
        F.size(F.filter(links, lambda l: l["text"] == "")).alias("missing_text"),
        nofollow.alias("nofollow"),
    )
    return out.withColumn("excessive_external", F.col("external") > max_external)


def is_http_link(u) -> Column:
    """Links that can name a page: ``mailto:``, ``javascript:`` and the like cannot."""
    return F.coalesce(scheme(_c(u)).isin("http", "https"), F.lit(False))


def normalize_url(u) -> Column:
    """Lower-case scheme and host, drop the fragment and a slash that ends the path; a
    port and the query stay."""
    u = _c(u)
    nofrag = F.regexp_replace(u, "#.*$", "")
    port = F.regexp_extract(nofrag, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*?(:[0-9]+)?(?:[/?]|$)", 1)
    rest = F.regexp_replace(nofrag, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    rest = F.regexp_replace(rest, r"^([^?]*?)/(\?|$)", "$1$2")
    return F.concat(scheme(u), F.lit("://"), host(u), port, rest)


def broken_links(links: DataFrame, pages: DataFrame, bad_status: int = 400) -> DataFrame:
    """http(s) links whose target is unknown or a known page with a bad status, by
    one left join on the normalised URL. Of several pages with one URL the best status
    counts. Links that cannot name a page (``mailto:``) are none."""
    lk = links.where(is_http_link("dst_url")).withColumn("_n", normalize_url("dst_url"))
    status = F.col("status_code") if "status_code" in pages.columns else F.lit(200)
    pg = pages.select(normalize_url("url").alias("_n"), status.cast("int").alias("_status"))
    pg = pg.groupBy("_n").agg(F.min("_status").alias("status_code"), F.lit(True).alias("_known"))
    reason = F.when(F.col("_known").isNull(), "unknown").when(F.col("status_code") >= bad_status, "bad_status")
    return lk.join(pg, "_n", "left").withColumn("reason", reason).where("reason IS NOT NULL").drop("_n", "_known")


def orphan_pages(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Pages no other page links to (self links ignored)."""
    pg = pages.select("page_id", "url", normalize_url("url").alias("_n"))
    src = pages.select(F.col("page_id").alias("src_page_id"), normalize_url("url").alias("_src"))
    targets = (
        links.withColumn("_n", normalize_url("dst_url"))
        .join(src, "src_page_id")
        .where(F.col("_n") != F.col("_src"))
        .select("_n")
        .distinct()
    )
    return pg.join(targets, "_n", "left_anti").drop("_n")


def linked_domains(links: DataFrame, approx: bool = False, own: bool = False) -> DataFrame:
    """Hosts that http(s) links lead to, with link counts and distinct linking
    pages; links that stay on the page's own host (``src_url``, if given) do not count.
    With ``own`` they do, and ``external_links`` and ``external_pages`` tell the others."""
    distinct = F.approx_count_distinct if approx else F.countDistinct
    links = links.where(is_http_link("dst_url"))
    found = [F.count(F.lit(1)).alias("links"), distinct("src_page_id").alias("pages")]
    if "src_url" in links.columns:
        away = ~host(F.col("dst_url")).eqNullSafe(host(F.col("src_url")))
        if own:
            found += [F.count(F.when(away, 1)).alias("external_links"), distinct(F.when(away, F.col("src_page_id"))).alias("external_pages")]
        else:
            links = links.where(away)
    return links.groupBy(host(F.col("dst_url")).alias("host")).agg(*found)


def match_host_rules(df: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """Rows whose URL host matches a rule: equal, or a dot-suffix. A rule with a leading
    dot matches proper subdomains only; empty rules match nothing.

    Rules meet the distinct hosts, not the rows: each host's suffixes are equi-joined with
    the rules' names, what fits is put together per host, and the rows take their host's
    rules by one join. A rule as wide as ``com`` meets each host once, whatever the number
    of pages; no theta join, and no job while planning."""
    keyed = df.withColumn("_host", host(F.col(url_col)))
    hosts = keyed.select("_host").where(F.col("_host").isNotNull()).distinct()
    suffixes = hosts.select("_host", F.posexplode(host_suffixes(F.col("_host"))).alias("_i", "_sfx"))
    named = rules.where(F.col("rule") != "").select("rule", F.regexp_replace("rule", r"^\.", "").alias("_sfx"), F.col("rule").startswith(".").alias("_dotted"))
    fits = suffixes.join(named, "_sfx").where((F.col("_i") > 0) | ~F.col("_dotted"))
    of_host = fits.groupBy("_host").agg(F.collect_list("rule").alias("_rules"))  # at most the rules of a name's labels
    # one row per (input row, matching rule)
    return keyed.join(of_host, "_host").select(*df.columns, F.explode("_rules").alias("rule"))


def metadata_check(parsed: DataFrame) -> DataFrame:
    """Presence flags per page."""
    nodes = F.col("nodes")
    parsed = parsed.select("page_id", "url", "nodes", _meta(nodes).alias("_meta"))
    meta = F.col("_meta")
    keys = F.map_keys(meta)
    scripts = _elements(nodes, ["script"])
    return parsed.select(
        "page_id",
        "url",
        (F.coalesce(meta["title"], F.lit("")) != "").alias("title"),
        F.map_contains_key(meta, "description").alias("description"),
        F.map_contains_key(meta, "viewport").alias("viewport"),
        _exists(nodes, lambda n: (n["tag"] == "meta") & F.map_contains_key(n["attrs"], "charset")).alias("charset"),
        F.map_contains_key(meta, "robots").alias("robots"),
        _has_rel(nodes, "canonical").alias("canonical"),
        _has_rel(nodes, "alternate").alias("alternate"),
        _exists(keys, lambda k: k.startswith("og:")).alias("open_graph"),
        _exists(keys, lambda k: k.startswith("twitter:")).alias("twitter"),
        _exists(scripts, lambda s: F.lower(F.coalesce(s["attrs"]["type"], F.lit(""))) == "application/ld+json").alias("json_ld"),
        _exists(nodes, lambda n: F.coalesce(n["attrs"]["itemtype"], F.lit("")).contains("schema.org")).alias("schema_org"),
    )


def metadata_coverage(check: DataFrame) -> DataFrame:
    """G3 by site: share of pages with each tag."""
    flags = [c for c in check.columns if c not in ("page_id", "url")]
    return check.groupBy(host(F.col("url")).alias("host")).agg(
        F.count(F.lit(1)).alias("pages"), *[F.round(F.avg(F.col(c).cast("double")), 4).alias(c) for c in flags]
    )


def accessibility_check(parsed: DataFrame) -> DataFrame:
    """G4 (structural items only): images without alt, generic link texts,
    inputs without a label, heading skips, skip link, landmarks."""
    nodes = F.col("nodes")
    parsed = parsed.select(
        "page_id", "nodes",
        F.transform(
            F.filter(nodes, lambda n: (n["tag"] == "label") & F.map_contains_key(n["attrs"], "for")),
            lambda n: n["attrs"]["for"],
        ).alias("_label_for"),
        heading_levels(nodes).alias("_lv"),
    )
    label_for = F.col("_label_for")
    imgs = _elements(nodes, ["img"])
    anchors = F.filter(nodes, lambda n: (n["tag"] == "a") & F.map_contains_key(n["attrs"], "href"))
    inputs = F.filter(
        nodes,
        lambda n: n["tag"].isin("input", "select", "textarea")
        & ~F.lower(F.coalesce(n["attrs"]["type"], F.lit("text"))).isin(*NO_LABEL_TYPES),
    )
    unlabeled = F.filter(
        inputs,
        lambda n: ~F.coalesce(F.array_contains(label_for, n["attrs"]["id"]), F.lit(False))
        & ~has_ancestor(n, ["label"])
        & ~F.map_contains_key(n["attrs"], "aria-label")
        & ~F.map_contains_key(n["attrs"], "aria-labelledby"),
    )
    generic = F.filter(
        anchors,
        lambda a: F.lower(node_text(nodes, a, " ")).isin(*GENERIC_LINK_TEXT),
    )
    skip = _exists(
        anchors,
        lambda a: a["attrs"]["href"].startswith("#") & F.lower(node_text(nodes, a, " ")).contains("skip"),
    )
    cols = [
        "page_id",
        F.size(F.filter(imgs, lambda i: ~F.map_contains_key(i["attrs"], "alt"))).alias("images_without_alt"),
        F.size(generic).alias("generic_link_text"),
        F.size(unlabeled).alias("inputs_without_label"),
        heading_skips(F.col("_lv")).alias("heading_skips"),
        skip.alias("skip_link"),
    ]
    def has(tag):
        return _exists(nodes, lambda n: n["tag"] == tag)

    cols += [has(t).alias(f"has_{t}") for t in LANDMARKS]
    return parsed.select(*cols)


def extract_data(df: DataFrame, text_col: str, key: str = "page_id",
                 types: list[str] | None = None) -> DataFrame:
    """``(key, type, value, count)`` of contact, pricing, date and number
    matches in the text."""
    kinds = types or list(EXTRACT_PATTERNS)

    def values(kind: str) -> Column:
        vals = F.regexp_extract_all(F.col(text_col), F.lit(EXTRACT_PATTERNS[kind]), 0)
        return F.filter(vals, lambda v: ~v.rlike(EXTRACT_EXCEPT[kind])) if kind in EXTRACT_EXCEPT else vals

    found = F.array(*[F.struct(F.lit(k).alias("type"), values(k).alias("vals")) for k in kinds])
    rows = df.select(key, F.inline(found)).select(key, "type", F.explode("vals").alias("value"))
    return rows.groupBy(key, "type", "value").agg(F.count(F.lit(1)).alias("count"))


def page_profile(parsed: DataFrame) -> DataFrame:
    """Element counts per focus group."""
    nodes = F.col("nodes")
    return parsed.select(
        "page_id", "url",
        *[F.size(_elements(nodes, tags)).alias(g) for g, tags in PROFILE_GROUPS.items()],
    )


def competitor_matrix(profile: DataFrame, sites: list[str]) -> DataFrame:
    """Aspects as rows, sites as columns (site = registrable domain, the
    last two host labels; the site list is given, which bounds the columns). Pages of
    all other sites count in the column ``other``."""
    aspects = list(PROFILE_GROUPS)
    site = F.regexp_extract(host(F.col("url")), r"([^.]+\.[^.]+)$", 1)
    stacked = profile.select(
        F.when(site.isin(*sites), site).otherwise("other").alias("site"),
        F.expr("stack({n}, {pairs}) as (aspect, value)".format(
            n=len(aspects), pairs=", ".join(f"'{a}', {a}" for a in aspects))),
    )
    return stacked.groupBy("aspect").pivot("site", [*sites, "other"]).agg(F.sum("value").cast("long"))


def _words(nodes: Column) -> Column:
    # one regex split over the page text (lines are separators anyway)
    return F.array_distinct(F.filter(
        F.split(F.lower(F.array_join(text_lines(nodes), "\n")), r"[^\p{L}\p{N}]+"),
        lambda w: w != "",
    ))


def page_features(parsed: DataFrame) -> DataFrame:
    """Distinct words, link targets and headings of each page (for U2/G7)."""
    nodes = F.col("nodes")
    return parsed.select(
        "page_id",
        "url",
        _words(nodes).alias("words"),
        F.array_distinct(F.transform(page_links("nodes", "url"), lambda l: l["url"])).alias("links"),
        F.array_distinct(F.transform(_elements(nodes, HEADINGS), lambda h: node_text(nodes, h, " "))).alias("headings"),
    )


def _jaccard(a, b) -> Column:
    a, b = _c(a), _c(b)
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared  # the lists are distinct
    return F.when(union == 0, F.lit(1.0)).otherwise(F.round(shared / union, 4))


def compare_to_reference(pages: DataFrame) -> DataFrame:
    """Each page against the reference page of its host (the lowest page_id): shared
    and own words, links and headings, and the Jaccard similarity of the words. One pair
    per page, so the work is linear in the pages. The reference pages are chosen by URL
    before anything is parsed, so no page's words travel to be compared for that."""
    hosted = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    chosen = hosted.groupBy("host").agg(F.min("page_id").alias("ref_id"))
    features = page_features(parse_pages(hosted.select("page_id", "url", "html"), keep_html=False))
    features = features.withColumn("host", host(F.col("url")))
    first = hosted.join(chosen, (hosted["host"] == chosen["host"]) & (hosted["page_id"] == chosen["ref_id"]), "left_semi")
    ref = page_features(parse_pages(first.select("page_id", "url", "html"), keep_html=False)).select(
        host(F.col("url")).alias("host"), F.col("page_id").alias("ref_id"),
        F.col("words").alias("ref_words"), F.col("links").alias("ref_links"), F.col("headings").alias("ref_headings"),
    )
    pairs = features.join(ref, "host").where(F.col("page_id") != F.col("ref_id"))
    return pairs.select(
        "host", "page_id", "ref_id",
        F.size(F.array_intersect("words", "ref_words")).alias("shared_words"),
        F.size(F.array_except("words", "ref_words")).alias("own_words"),
        F.size(F.array_intersect("links", "ref_links")).alias("shared_links"),
        F.size(F.array_except("headings", "ref_headings")).alias("own_headings"),
        _jaccard("words", "ref_words").alias("word_jaccard"),
    )


def page_items(features: DataFrame) -> DataFrame:
    """The words, links and headings of pages as rows (page_id, url, kind, item)."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}s").alias("items")) for k in ("word", "link", "heading")])
    return features.select("page_id", "url", F.inline(kinds)).select("page_id", "url", "kind", F.explode("items").alias("item"))


def url_places(pages: DataFrame, urls) -> DataFrame:
    """A list of URLs as (url, place), places from 0 and each URL once; a frame with these
    columns is taken as it is."""
    if isinstance(urls, DataFrame):
        return urls.select("url", "place")
    rows = [(u, i) for i, u in enumerate(dict.fromkeys(urls))]
    return pages.sparkSession.createDataFrame(rows, "url string, place int")


def compare_list(pages: DataFrame, urls) -> DataFrame:
    """What the pages of a list of URLs share, as rows: (kind, item, n_pages, pages,
    on_all), one for each distinct word, link or heading, with the places in ``urls`` of the
    pages that have it. ``n_pages`` 1 means that only that page has it; ``on_all`` that
    every page of the list that was found has it. Pages are picked before they are parsed;
    several stored pages of one URL count as one. The row of an item is as long as the
    list, so items met by many pages make no pairs."""
    wanted = url_places(pages, urls)
    picked = pages.select("page_id", "url", "html").join(wanted, "url", "left_semi")
    items = page_items(page_features(parse_pages(picked, keep_html=False))).join(wanted, "url")
    found = pages.select("url").join(wanted, "url").agg(F.count_distinct("place")).scalar()
    return items.groupBy("kind", "item").agg(F.array_sort(F.collect_set("place")).alias("pages")).select(
        "kind", "item", F.size("pages").alias("n_pages"), "pages", (F.size("pages") == found).alias("on_all")
    )


def compare_pairs(pages: DataFrame, urls) -> DataFrame:
    """Every two pages of a list of URLs (places ``a`` < ``b``): per kind of item how
    many they share, how many only one has, and the Jaccard similarity. The pairs are those
    of the list; counts come from the items' rows by one aggregation."""
    items = compare_list(pages, urls).select("kind", "pages")
    sizes = items.select("kind", F.explode("pages").alias("place")).groupBy("kind", "place").agg(F.count(F.lit(1)).alias("n"))
    places = pages.select("url").join(url_places(pages, urls), "url").select("place").distinct()
    kinds = F.explode(F.array(*[F.lit(k) for k in ("word", "link", "heading")])).alias("kind")
    every = places.select("place", kinds).join(sizes, ["kind", "place"], "left").na.fill(0, ["n"])
    left = every.select("kind", F.col("place").alias("a"), F.col("n").alias("n_a"))
    pairs = left.join(every.select("kind", F.col("place").alias("b"), F.col("n").alias("n_b")), "kind").where("a < b")
    first = items.select("kind", "pages", F.explode("pages").alias("a"))
    both = first.select("kind", "a", F.explode(F.filter("pages", lambda x: x > F.col("a"))).alias("b"))
    shared = both.groupBy("kind", "a", "b").agg(F.count(F.lit(1)).alias("shared"))
    out = pairs.join(shared, ["kind", "a", "b"], "left").na.fill(0, ["shared"])
    union = F.col("n_a") + F.col("n_b") - F.col("shared")
    return out.select(
        "kind", "a", "b", "shared", (F.col("n_a") - F.col("shared")).alias("only_a"), (F.col("n_b") - F.col("shared")).alias("only_b"),
        F.when(union == 0, F.lit(1.0)).otherwise(F.round(F.col("shared") / union, 4)).alias("jaccard"),
    )


#: What one cell of a comparison holds at most, about: words and classes.
CELL_WORDS, CELL_CLASSES = 6_000_000, 24_000


def _overlapping(at_least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from overlapping(pa.Table.from_batches(list(batches)), at_least)

    return run


def similar_pages(features: DataFrame, at_least: float = 0.5, group: Column | None = None,
                  bands: int | None = None, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """G7 over large groups: pages of one ``group`` (default: the host) whose words have a
    Jaccard similarity of ``at_least`` or more, as (links, members).

    Pages with equal words are one class: ``members`` has (page_id, class_id), the least
    page_id. ``links`` has (group, class_a, class_b, shared, jaccard) of two classes. All
    links are found: a group's classes are cut, by size, into cells of bounded content, and
    every two cells whose sizes allow a link meet in a task, which bounds the shared words
    of all their pairs by matrix products over hashed words and counts those that may link
    word by word, by 64-bit hashes (functions/overlap.py). Only links become rows.
    ``bands`` and ``rows`` (of the MinHash filter that this replaces, which missed some)
    change nothing. Pages without words are alike."""
    key = host(F.col("url")) if group is None else group
    one = features.select("page_id", key.alias("group"), F.array_sort("words").alias("words"))
    one = one.withColumn("digest", F.sha2(F.array_join("words", " "), 256))
    hashed = F.transform("words", lambda w: F.xxhash64(w)).alias("items")
    classes = one.select("page_id", "group", "digest", hashed).groupBy("group", "digest").agg(F.min("page_id").alias("class_id"), F.first("items").alias("items"))
    checkpoint_dir(features.sparkSession)
    classes = classes.checkpoint()  # parsed once, read several times
    members = one.join(classes.select("group", "digest", "class_id"), ["group", "digest"]).select("page_id", "class_id")
    sized = classes.select("group", "class_id", "items", F.size("items").alias("n")).where("n > 0 AND class_id IS NOT NULL")
    # sizes in order fill cells; a size that fills one alone has cells of its own
    sizes = sized.groupBy("group", "n").agg(F.count(F.lit(1)).alias("_all"))
    sizes = sizes.withColumn("_fill", F.col("_all") * (F.col("n") / CELL_WORDS + F.lit(1 / CELL_CLASSES)))
    before = F.sum("_fill").over(Window.partitionBy("group").orderBy("n")) - F.col("_fill")
    alone = F.when(F.col("_fill") >= 1, F.col("n"))
    cells = sizes.select("group", "n", "_fill", F.floor(before).alias("_nth"), alone.alias("_alone")).groupBy("group", "_nth", "_alone").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.ceil(F.when(F.col("_alone").isNull(), 1).otherwise(F.max("_fill"))).cast("int").alias("parts"))
    cells = cells.groupBy(F.col("group").alias("_group")).agg(F.collect_list(F.struct("lo", "hi", "parts")).alias("cells"))
    dealt = sized.join(cells, F.col("group").eqNullSafe(F.col("_group")))
    dealt = dealt.withColumn("own", F.element_at(F.filter("cells", lambda c: F.col("n").between(c["lo"], c["hi"])), 1))
    near = F.filter("cells", lambda c: (c["lo"] * at_least <= F.col("own.hi")) & (F.col("own.lo") * at_least <= c["hi"]))
    cell = lambda lo, part: F.struct(lo.alias("lo"), part.cast("int").alias("part"))
    others = F.flatten(F.transform(near, lambda c: F.transform(F.sequence(F.lit(0), c["parts"] - 1), lambda k: cell(c["lo"], k))))
    dealt = dealt.select("group", "class_id", "items", cell(F.col("own.lo"), F.pmod(F.xxhash64("class_id"), F.col("own.parts"))).alias("me"), F.explode(others).alias("you"))
    dealt = dealt.select("group", "class_id", "items", F.least("me", "you").alias("a"), F.greatest("me", "you").alias("b"), (F.col("me") <= F.col("you")).alias("left"))
    tasks = max(int(features.sparkSession.conf.get("spark.sql.shuffle.partitions")), 96)  # few bytes, much work: not to be merged
    types = {f.name: f.dataType.simpleString() for f in sized.schema}
    pairs = dealt.repartition(tasks, "group", "a", "b").groupBy("group", "a", "b").applyInArrow(
        _overlapping(at_least), f"group {types['group']}, one {types['class_id']}, other {types['class_id']}, shared int, union int")
    links = pairs.select("group", F.least("one", "other").alias("class_a"), F.greatest("one", "other").alias("class_b"), "shared", F.round(F.col("shared") / F.col("union"), 4).alias("jaccard"))
    return links.where("class_a < class_b"), members


def merge_lists(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Union of two lists without duplicates."""
    return a.select(col).union(b.select(col)).distinct()


def top_sources(citations: DataFrame, k: int = 3, group: str = "topic") -> DataFrame:
    """L4: the ``k`` most cited hosts per topic (``k=None`` keeps all)."""
    from webtables.operators.rows import top_k_per_group

    counts = citations.groupBy(group, host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("citations"))
    order = [F.col("citations").desc(), F.col("host")]
    if k is None:
        return counts.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return top_k_per_group(counts, [group], order, k, "host")
