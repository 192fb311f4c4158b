"""Views derived from the driver's tables (FIXTURES.md section 3).

``request_log`` and ``attempts`` turn ``events`` into a request log and a
per-try log; ``page_store`` is the successful fetches of the TTL fold with
page content; ``graph_links``, ``host_rules`` and ``answers`` give the audit
and citation jobs their positive cases. Every view grows with its source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtables.functions.urls import cache_key as cache_key_of
from webtables.sources.tables import read_table

# Derived-view rules (FIXTURES.md section 3).
HOST_BY_TYPE = {"signup": "api", "view": "cdn", "purchase": "live"}
OTHER_HOST = "www"
ANSWER_TYPE = "purchase"
PAGE_REQUEST = "scraper"
ANSWER_REQUEST = "answer"
HOST_RULES = [".example.org", "example.net", "spam-farm.example.org"]
GONE_URL = "https://gone.example.com/"


# What the audit cases add to a page, by page number: (place, modulus, remainder, markup).
# The pages have few tags; these give each audit check pages that pass and pages that fail.
AUDIT_CASES = [
    ("head", 2, 0, '<meta name="description" content="' + "plain words " * 13 + '">'),
    ("head", 4, 1, '<meta name="description" content="short">'),
    ("head", 3, 0, '<meta name="viewport" content="width=device-width">'),
    ("head", 5, 0, '<meta name="robots" content="noindex">'),
    ("head", 7, 0, '<link rel="canonical" href="/c">'),
    ("head", 7, 1, '<link rel="alternate" hreflang="de" href="/de">'),
    ("head", 4, 0, '<meta property="og:title" content="T"><meta property="og:description" content="D"><meta property="og:image" content="/i.png">'),
    ("head", 6, 0, '<meta name="twitter:card" content="summary"><meta name="twitter:title" content="T"><meta name="twitter:description" content="D">'),
    ("head", 9, 0, '<script type="application/ld+json">{"@type": "Article"}</script>'),
    ("body", 2, 1, "<h3>Far below</h3>"),
    ("body", 3, 1, '<img src="/bare.png">'),
    ("body", 3, 2, '<img src="/named.png" alt="Named">'),
    ("body", 4, 0, '<form><label>Name <input name="n"></label><label for="m">Mail</label><input id="m"><input name="lost"><input type="hidden"></form>'),
    ("body", 5, 1, '<a href="https://other.example/x" rel="nofollow">here</a><a href="mailto:desk@other.example">Desk</a>'),
    ("body", 5, 2, '<a href="https://third.example/"> </a><a href="#main">Skip to content</a>'),
    ("body", 8, 0, '<div itemscope itemtype="https://schema.org/Person"><meta name="author" content="A"></div>'),
    ("body", 10, 0, '<video src="/v.mp4"></video><button>Go</button>'),
]


def audit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``audit_pages(page_id, url, html)``: the pages with the markup of AUDIT_CASES before
    the end of their head and of their article."""
    added = {
        at: F.concat(*[F.when(F.col("page_id") % m == r, F.lit(x)).otherwise(F.lit("")) for place, m, r, x in AUDIT_CASES if place == at])
        for at in ("head", "body")
    }
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    html = F.replace("html", F.lit("</head>"), F.concat(added["head"], F.lit("</head>")))
    return pages.withColumn("html", F.replace(html, F.lit("</article>"), F.concat(added["body"], F.lit("</article>"))))


def request_log_from_events(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    et = F.col("event_type")
    h = F.lit(OTHER_HOST)
    for t, v in reversed(list(HOST_BY_TYPE.items())):
        h = F.when(et == t, F.lit(v)).otherwise(h)
    url = F.concat(F.lit("https://"), h, F.lit(".example.com/u/"), F.col("user_id").cast("string"))
    success = et != "error"
    return (
        events.select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))
        .select(
            F.col("event_id").alias("request_id"),
            F.col("ts"),
            url.alias("url"),
            success.alias("success"),
            F.when(success, F.lit(200)).when(F.col("k") % 2 == 0, F.lit(429)).otherwise(F.lit(500)).alias("status_code"),
            F.col("value").alias("elapsed_ms"),
            F.when(success, 1 + F.col("k") % 4).otherwise(F.lit(1)).alias("attempts"),
            F.when(~success, F.concat(F.lit("Timeout: "), F.col("k").cast("string"))).alias("error"),
            F.when(et == ANSWER_TYPE, F.lit(ANSWER_REQUEST)).otherwise(F.lit(PAGE_REQUEST)).alias("request_type"),
            F.col("k"),
        )
        .withColumn("cache_key", cache_key_of(F.col("url")))
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``request_log(request_id, ts, url, success, status_code, elapsed_ms,
    attempts, error, request_type, cache_key)`` (+ helper column ``k``).

    ``spark.webtables.spread`` spreads a log of few splits over more tasks."""
    from webtables.session import spread

    return request_log_from_events(spread(read_table(spark, sf_dir, "events")))


def attempts_from_log(log: DataFrame) -> DataFrame:
    """``attempts(request_id, attempt_ts, ok, error)``: n = 1 + k%4 tries on
    success, 4 on failure; try i at ts + (2^(i-1) - 1) s; ok on the last try
    of a successful request."""
    n = F.when(F.col("success"), 1 + F.col("k") % 4).otherwise(F.lit(4))
    tries = log.select("request_id", "ts", "success", "k", F.explode(F.sequence(F.lit(1), n)).alias("i"), n.alias("n"))
    ok = F.col("success") & (F.col("i") == F.col("n"))
    return tries.select(
        "request_id",
        F.timestamp_add("SECOND", (F.pow(F.lit(2), F.col("i") - 1) - 1).cast("int"), F.col("ts")).alias("attempt_ts"),
        ok.alias("ok"),
        F.when(~ok, F.concat(F.lit("Timeout: "), F.col("k").cast("string"))).alias("error"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts_from_log(request_log(spark, sf_dir))


def user_of(url) -> F.Column:
    return F.regexp_extract(url, r"/u/(\d+)$", 1).cast("long")


def page_store(spark: SparkSession, sf_dir: str, ttl_override: int | None = None,
               labelled: DataFrame | None = None) -> DataFrame:
    """``page_store(cache_key, url, content, fetched_at, ttl_s)``: successful
    fetches of the TTL fold (R2); content is page ``user_id % count(pages)``.
    Pass ``labelled`` (the fold's output) to reuse a fold already planned."""
    from webtables.operators.freshness import label_fetches

    if labelled is None:
        labelled = label_fetches(request_log(spark, sf_dir), ttl_override=ttl_override)
    stored = labelled.where((F.col("label") == "fetch") & F.col("success")).select(
        "cache_key", "url", F.col("ts").alias("fetched_at"), "ttl_s", user_of(F.col("url")).alias("user_id")
    )
    pages = read_table(spark, sf_dir, "pages").select("page_id", "html")
    # the page count is a scalar subquery (one value), not a join
    n_pages = pages.agg(F.count(F.lit(1))).scalar()
    keyed = stored.withColumn("page_id", F.col("user_id") % n_pages)
    return keyed.join(pages, "page_id").select(
        "cache_key", "url", F.col("html").alias("content"), "fetched_at", "ttl_s"
    )


def fetch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fetch_results(page_id, url, html, status_code, content_type, error, metadata)``: a
    page with the record of its fetch, which is the event of the same number (k: its ``k``).
    A fetch whose event is an error failed and has no page; metadata holds the sparse fields
    of ``schema.FETCH_META``."""
    k = F.col("k")
    ev = read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("page_id"), "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k")
    )
    ok = F.coalesce(F.col("event_type") != "error", F.lit(True))
    kind = F.when(k % 3 == 0, F.lit("application/xhtml+xml")).otherwise(F.lit("text/html; charset=utf-8"))
    meta = F.struct(
        F.col("value").alias("elapsed_ms"),
        (1 + k % 4).alias("attempts"),
        (k % 4).alias("retries"),
        (k % 5 == 0).alias("from_cache"),
        (k % 7 == 0).alias("proxy_used"),
        F.when(k % 7 == 0, F.create_map(F.lit("country"), F.lit("us"))).alias("proxy_config"),
        F.create_map(F.lit("content-type"), kind, F.lit("x-k"), k.cast("string")).alias("headers"),
        (k % 6 == 0).alias("rendered_js"),
        F.when(k % 11 == 0, F.concat("url", F.lit("/moved"))).alias("final_url"),
    )
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return pages.join(ev, "page_id", "left").select(
        "page_id", "url",
        F.when(ok, F.col("html")).alias("html"),
        F.when(ok, F.lit(200)).when(k % 2 == 0, F.lit(429)).otherwise(F.lit(500)).alias("status_code"),
        F.when(ok, kind).alias("content_type"),
        F.when(~ok, F.concat(F.lit("Timeout: "), k.cast("string"))).alias("error"),
        F.when(k.isNotNull(), meta).alias("metadata"),
    )


def store_totals(spark: SparkSession, sf_dir: str, labelled: DataFrame) -> DataFrame:
    """One pass over the labelled log: store entries and bytes (successful
    fetches, sized by their page) with hits and misses, in one aggregate."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", F.octet_length("html").alias("_bytes"))
    n_pages = pages.agg(F.count(F.lit(1))).scalar()
    stored = (F.col("label") == "fetch") & F.col("success")
    j = (
        labelled.select("url", "label", "success")
        .withColumn("page_id", F.when(stored, user_of(F.col("url")) % n_pages))
        .join(pages, "page_id", "left")
    )
    return j.agg(
        F.coalesce(F.sum(stored.cast("long")), F.lit(0)).alias("entry_count"),
        F.coalesce(F.sum(F.when(stored, F.col("_bytes"))), F.lit(0)).cast("long").alias("size_bytes"),
        F.coalesce(F.sum((F.col("label") == "served").cast("long")), F.lit(0)).alias("hits"),
        F.coalesce(F.sum((F.col("label") == "fetch").cast("long")), F.lit(0)).alias("misses"),
    )


def graph_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``graph_links(src_page_id, src_url, dst_url)``: page p links to the URL of page
    (7p+3) % N unless p % 3 = 0, and to a gone URL when p % 5 = 0."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    src = pages.select("page_id").withColumn("n_pages", pages.agg(F.count(F.lit(1))).scalar())
    to_page = src.where(F.col("page_id") % 3 != 0).select(
        F.col("page_id").alias("src_page_id"), ((7 * F.col("page_id") + 3) % F.col("n_pages")).alias("dst_page_id")
    )
    internal = to_page.join(pages.withColumnRenamed("page_id", "dst_page_id"), "dst_page_id").select(
        "src_page_id", F.col("url").alias("dst_url")
    )
    gone = src.where(F.col("page_id") % 5 == 0).select(
        F.col("page_id").alias("src_page_id"), F.concat(F.lit(GONE_URL), F.col("page_id").cast("string")).alias("dst_url")
    )
    both = internal.unionByName(gone)
    return both.join(pages.select(F.col("page_id").alias("src_page_id"), F.col("url").alias("src_url")), "src_page_id").select("src_page_id", "src_url", "dst_url")


def host_rules(spark: SparkSession) -> DataFrame:
    """``host_rules(rule)``: the domain-list rules table (three rows)."""
    return spark.createDataFrame([(r,) for r in HOST_RULES], "rule string")


def word_count(text) -> F.Column:
    return F.size(F.split(F.trim(text), r"\s+"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``answers(conv_id, turn, content, citations, usage)``: assistant turns;
    citations are the URLs of pages (conv_id + turn + i) % N, i = 0..2;
    usage is word counts (prompt = previous turn, completion = this turn)."""
    from pyspark.sql import Window

    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = conv.withColumn("prev_words", F.lag(word_count(F.col("text"))).over(w))
    asst = turns.where(F.col("role") == "assistant").withColumn("n_pages", pages.agg(F.count(F.lit(1))).scalar())
    cited = asst.select(
        "conv_id", "turn", "text", "prev_words", F.posexplode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("rank", "i"), "n_pages"
    ).withColumn("page_id", (F.col("conv_id") + F.col("turn") + F.col("i")) % F.col("n_pages"))
    joined = cited.join(pages, "page_id")
    comp = word_count(F.col("text"))
    prompt = F.coalesce(F.col("prev_words"), F.lit(0))
    return joined.groupBy("conv_id", "turn").agg(
        F.first("text").alias("text"),
        F.first("prev_words").alias("prev_words"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda s: s["url"]).alias("citations")
    ).select(
        "conv_id",
        "turn",
        F.col("text").alias("content"),
        "citations",
        F.create_map(
            F.lit("prompt_tokens"), prompt, F.lit("completion_tokens"), comp, F.lit("total_tokens"), prompt + comp
        ).alias("usage"),
    )
