"""URL rules whose block decisions reach a page's aliases (operator 10).

A page's own rule decides first. A page without one takes the decision of its aliases:
the URLs connected to its own by redirects and canonical links, which are found as
connected components in Spark. An explicit allow among the aliases takes precedence
over a block; without either the page is allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtables.functions.urls import resolve_url

from .common import ready
from .components import components

#: (verdict, host, path) of a rule.
Rule = tuple[str, str, str]


def host_of(url) -> F.Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url) -> F.Column:
    """From the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def best_rule(host, path, rules: list[Rule]) -> F.Column:
    """The longest fitting rule as struct(length, allow, rule); of two as long, allow.
    The rules are a short parameter list and become one expression."""
    fits = []
    for verdict, h, p in rules:
        on = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        fits.append(F.when(on, F.struct(F.lit(len(h + p)).alias("length"), F.lit(verdict == "allow").alias("allow"), F.lit(h + p).alias("rule"))))
    none = F.lit(None).cast("struct<length:int,allow:boolean,rule:string>")
    return F.greatest(none, none, *fits) if fits else none


def node_of(url) -> F.Column:
    """The URL without its fragment, host lower-cased: what a redirect or link names."""
    bare = F.regexp_extract(url, "(?s)^[^#]*", 0)
    return F.concat(F.regexp_extract(bare, r"(?s)^.*?://", 0), host_of(bare), F.regexp_extract(bare, r"(?s)^.*?://[^/?#]*(.*)$", 1))


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): a page's URL, and each URL that one of its canonical links or refresh redirects
    names, resolved against the page; tags that name none are passed over."""
    html = F.col("html")
    pick = lambda tag, having: F.filter(F.regexp_extract_all(html, F.lit(f"(?is)<{tag}\\b[^>]*>"), F.lit(0)), lambda t: t.rlike(having))
    value = lambda t, at: F.coalesce(*[F.nullif(F.regexp_extract(t, at + q, 1), F.lit("")) for q in ("\\s*\"([^\"]*)\"", "\\s*'([^']*)'", "\\s*([^\\s\"'>;]+)")])
    rel, refresh = r"(?is)\brel\s*=\s*[\"']?\s*canonical\b", r"(?is)\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"
    canonical = F.transform(pick("link", rel), lambda t: value(t, r"(?is)\bhref\s*="))
    redirect = F.transform(pick("meta", refresh), lambda t: F.nullif(F.trim(F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?([^\"'>]+)", 1)), F.lit("")))
    tagged = pages.select(pages[url_col].alias("url"), pages[html_col].alias("html")).where(html.rlike("(?i)canonical|refresh") & F.col("url").contains("://"))
    targets = tagged.select("url", F.explode(F.array_distinct(F.concat(canonical, redirect))).alias("to")).where("to IS NOT NULL")
    return targets.select(node_of(F.col("url")).alias("a"), node_of(resolve_url(F.col("url"), F.col("to"))).alias("b"))


def judge_urls(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """One row per row of ``pages``: id_col, url, host, path, rule (``host/path`` or null), verdict.

    ``redirects`` (a, b: URLs) adds observed redirects to those found in the pages. A
    URL that only a link names counts too: a rule that fits it decides for its aliases.
    A null URL, or one without ``://``, has an empty host and path, fits no rule and has
    no aliases: allow. Null ids and repeated rows stay as they are; other columns are
    not read. An empty table gives no rows."""
    ready(pages.sparkSession)
    edges = link_edges(pages, url_col, html_col) if html_col else None
    if redirects is not None:
        more = redirects.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b"))
        edges = edges.union(more) if edges is not None else more
    url = pages[url_col]
    rows = pages.select(pages[id_col], url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("own", best_rule(F.col("host"), F.col("path"), rules))
    by_alias = F.lit(None).cast("boolean")
    if edges is not None:
        alias = components(edges)
        own = best_rule(host_of(F.col("node")), path_of(F.col("node")), rules)
        said = alias.select("component", own["allow"].alias("allow")).where("allow IS NOT NULL").groupBy("component").agg(F.max("allow").alias("alias_allow"))
        told = alias.join(said, "component").select(F.col("node").alias("__node"), "alias_allow")
        rows = rows.withColumn("__node", node_of(F.col("url"))).join(told, "__node", "left")
        by_alias = F.col("alias_allow")
    allow = F.coalesce(F.col("own.allow"), by_alias, F.lit(True))
    return rows.select(id_col, "url", "host", "path", F.col("own.rule").alias("rule"), F.when(allow, "allow").otherwise("block").alias("verdict"))
