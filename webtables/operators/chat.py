"""Conversation and answer-log jobs: last user prompt (W2, W3), token usage
(A11), citations (C1) and the answer-log outcome classes (C2, with A12).

The last user turn per conversation is a ``max_by`` aggregate (partial
aggregation map-side), not a sort of each conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtables.functions.text import answer_log_url, collapse_ws, truncate_ellipsis
from webtables.functions.urls import host
from webtables.operators.requests import outcome_class

NO_PROMPT = "(no prompt)"
PROMPT_MAX = 80


def last_user_message(messages: DataFrame) -> DataFrame:
    """The full last user message per conversation, ``""`` if none."""
    return messages.groupBy("conv_id").agg(
        F.coalesce(
            F.max_by(F.col("text"), F.when(F.col("role") == "user", F.col("turn"))),
            F.lit(""),
        ).alias("prompt")
    )


def prompt_preview(messages: DataFrame, max_length: int = PROMPT_MAX) -> DataFrame:
    """Last user message with whitespace collapsed, cut to
    ``max_length`` (with ``...``), or ``(no prompt)``."""
    has_user = F.max((F.col("role") == "user").cast("int")) == 1
    last = F.max_by(F.col("text"), F.when(F.col("role") == "user", F.col("turn")))
    g = messages.groupBy("conv_id").agg(has_user.alias("_has"), last.alias("_last"))
    return g.select(
        "conv_id",
        F.when(F.col("_has"), truncate_ellipsis(collapse_ws(F.coalesce("_last", F.lit(""))), max_length))
        .otherwise(F.lit(NO_PROMPT)).alias("prompt"),
    )


def answer_urls(messages: DataFrame, model: str = "sonar") -> DataFrame:
    """The answer-service log URL of each conversation."""
    return prompt_preview(messages).select("conv_id", answer_log_url(F.lit(model), F.col("prompt")).alias("url"))


def token_usage(answers: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Prompt, completion and total tokens (null -> 0), summed."""
    u = F.col("usage")
    cols = [
        F.sum(F.coalesce(u["prompt_tokens"], F.lit(0))).cast("long").alias("prompt_tokens"),
        F.sum(F.coalesce(u["completion_tokens"], F.lit(0))).cast("long").alias("completion_tokens"),
        F.sum(F.coalesce(u["total_tokens"], F.lit(0))).cast("long").alias("total_tokens"),
    ]
    return (answers.groupBy(*by) if by else answers).agg(F.count(F.lit(1)).alias("answers"), *cols)


def citation_table(answers: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per (answer, rank, url), joined to pages by URL (left:
    citations of pages not crawled keep a null page_id; of several pages with
    one URL the least id counts)."""
    cited = answers.select("conv_id", "turn", F.posexplode("citations").alias("rank", "url"))
    pages = pages.groupBy("url").agg(F.min("page_id").alias("page_id"))
    return cited.join(pages, "url", "left").withColumn("host", host(F.col("url")))


def urls_in_text(messages: DataFrame) -> DataFrame:
    """C1 on raw text: URLs found in assistant messages."""
    return messages.where(F.col("role") == "assistant").select(
        "conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(r"https?://[^\s<>\"')\]]+"), 0)).alias("rank", "url")
    )


def classify_answers(log: DataFrame) -> DataFrame:
    """Status class and ``rate_limited`` from the error text."""
    cls = outcome_class(F.col("error"))
    return log.withColumn("status_class", cls).withColumn("rate_limited", cls == 429)
