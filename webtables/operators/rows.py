"""Combining one-row aggregates into one report row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def side_by_side(*one_row_frames: DataFrame) -> DataFrame:
    """Put the columns of several one-row aggregates into one row.

    Each later input is a global aggregate (exactly one row), read as a
    scalar subquery: no join is planned at all."""
    base = one_row_frames[0]
    cols = [F.col(c) for c in base.columns]
    for f in one_row_frames[1:]:
        s = f.select(F.struct(*f.columns).alias("s")).scalar()
        cols += [s[c].alias(c) for c in f.columns]
    return base.select(*cols)


def top_k_per_group(df: DataFrame, group: list[str], order: list, k: int, salt_col: str,
                    salts: int = 64, rank_col: str = "rank") -> DataFrame:
    """Exact top-``k`` rows per group without putting a group in one task:
    rank inside ``(group, salt)`` (salt = hash of ``salt_col``), keep ``k``
    per salt, then rank the at most ``salts * k`` survivors per group.
    ``order`` must be a total order (ties broken) for a stable result."""
    from pyspark.sql import Window

    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_col), F.lit(salts)))
    w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
    stage1 = salted.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k).drop("_r", "_salt")
    w2 = Window.partitionBy(*group).orderBy(*order)
    return stage1.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k)
