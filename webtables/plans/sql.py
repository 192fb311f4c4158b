"""The library for SQL users: temp views for every table, page markdown among
them, and ``url_join`` as a SQL function of built-in expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def register(spark: SparkSession, sf_dir: str) -> list[str]:
    """Create temp views ``pages, nodes, links, page_meta, page_markdown,
    request_log, attempts, page_store, messages`` and the SQL function
    ``url_join(base, href)``. Views are lazy: nothing runs until queried."""
    from webtables.functions import sqltext
    from webtables.operators.audits import link_rows
    from webtables.operators.content import page_metadata
    from webtables.operators.parse import explode_nodes, parse_pages
    from webtables.sources import derived as D
    from webtables.sources.tables import pages, read_table

    pg = pages(spark, sf_dir)
    parsed = parse_pages(pg, keep_html=False)
    views = {
        "pages": pg,
        "nodes": explode_nodes(parsed),
        "links": link_rows(parsed),
        "page_meta": parsed.select("page_id", F.explode(page_metadata("nodes")).alias("key", "value")),
        "page_markdown": parse_pages(pg, keep_html=False, markdown_strip=[]).select("page_id", "markdown", "parse_error"),
        "request_log": D.request_log(spark, sf_dir).drop("k"),
        "attempts": D.attempts(spark, sf_dir),
        "page_store": D.page_store(spark, sf_dir),
        "messages": read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    joined = sqltext.resolve_url("base", "href")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION url_join(base STRING, href STRING) RETURNS STRING RETURN {joined}")
    return list(views)
