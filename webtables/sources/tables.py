"""Table sources. Any DataFrame with the ``pages`` schema is a
valid page source; the driver's parquet tables are read with their schema and
only the needed columns are selected (parquet column pruning)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtables.session import configure


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages(page_id, url, html)``."""
    return read_table(spark, sf_dir, "pages").select("page_id", "url", "html")


def url_list(spark: SparkSession, urls: list[str]) -> DataFrame:
    """An input URL list with positions (``pos`` keeps input order and
    duplicates). An empty list gives an empty frame with the same schema."""
    configure(spark)
    return spark.createDataFrame(
        [(i, u) for i, u in enumerate(urls)], "pos int, url string"
    )


def url_array_positions(df: DataFrame, col: str = "urls") -> DataFrame:
    """S2 for an array column: one row per element with its position."""
    return df.select("*", F.posexplode(col).alias("pos", "url")).drop(col)
