"""The corpus pipeline: quality classifier, exact dedup, near-duplicate join, substring
dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read back as the next one's ``docs``; all but the last return the columns of
``documents``, and each works on all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webtables.llm import exact_dedup, ngram_join, packing, quality, substring_dedup
from webtables.llm.common import shared_path
from webtables.llm.queries import tokenizer_path


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier scores as good stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, labels)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 stays."""
    return ngram_join.one_of_each(docs, size=5, percent=80)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document holds go from the later one.

    A text that loses words becomes its kept words joined by one space; ``n_chars`` is
    then counted anew."""
    return substring_dedup.without_repeats(docs, length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 2048."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("quality_classifier", reject_low_quality),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", drop_passages),
    ("best_fit_packing", pack),
]

#: The first stage is a trained model, which SQL cannot state; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
