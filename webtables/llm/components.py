"""Connected components of an edge table by alternating stars.

Each round joins every node's neighbours to the least node next to it, first upwards
(larger neighbours) and then downwards, until every component is a star around its
least node. The number of rounds grows with the logarithm of the component size. All
steps are joins and aggregates with partial sums; nothing comes to the driver but a
row of totals a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node on an edge; ``component`` is the least node that
    it is connected to. Nulls and loops are left out; repeated edges count once."""
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    e = cut(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(u, v).distinct())
    before = None
    while True:
        total = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if total == before or not total["n"]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        before = total
        both = e.union(e.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(down.union(least.select("u", "m")).distinct())
