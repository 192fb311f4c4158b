"""Saved fetch records as a table.

A record is one JSON object a line: the URL, the content, status, type, an error, and the
fetch's metadata, whose fields differ from record to record. It is read with a declared
schema, so a query parses only the columns it needs, and metadata stays a VARIANT until a
field is asked for. Files are split over tasks as any JSON lines are; a line that is not a
record becomes a row with an error, beside the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webtables.schema import FETCH_META
from webtables.session import configure

RECORD = "page_id long, url string, html string, status_code int, content_type string, error string, metadata variant, _bad string"


def read_fetches(spark: SparkSession, path: str) -> DataFrame:
    """The records under ``path``: page_id, url, html, status_code, content_type, error,
    metadata (VARIANT). Absent fields are null."""
    configure(spark)
    rows = spark.read.schema(RECORD).option("columnNameOfCorruptRecord", "_bad").json(path)
    broken = F.concat(F.lit("ValueError: not a fetch record: "), F.substring("_bad", 1, 80))
    return rows.withColumn("error", F.coalesce("error", F.when(F.col("_bad").isNotNull(), broken))).drop("_bad")


def write_fetches(fetched: DataFrame, path: str) -> None:
    """Append records as JSON lines; null fields are left out."""
    names = [c.split(" ")[0] for c in RECORD.split(", ") if not c.startswith("_")]
    fetched.select(*[c for c in names if c in fetched.columns]).write.mode("append").json(path)


def metadata_struct(metadata: Column) -> Column:
    """The fields of ``schema.FETCH_META`` out of a VARIANT; a field that is absent or of
    another kind is null."""
    return F.when(
        metadata.isNotNull(),
        F.struct(*[F.try_variant_get(metadata, f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in FETCH_META.fields]),
    )


def fetched_pages(spark: SparkSession, path: str) -> DataFrame:
    """The records as a source of the page jobs: metadata as a struct."""
    rows = read_fetches(spark, path)
    return rows.withColumn("metadata", metadata_struct(F.col("metadata")))
