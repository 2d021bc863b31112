"""Connected components of a link table, by alternating star contractions.

Every round hangs the neighbours of a node under the smallest of them, first the larger
ones, then the smaller ones. Trees halve in depth, and the end is one star per component
around its smallest id. All rounds are joins and aggregations; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlane.llm.common import stored


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``root`` (smallest id reachable) for every id that has a link.

    Null ends and loops are ignored, repeated links count once, no links give no rows.
    """
    edges = stored(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        upper = (
            edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
            .join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large = upper.where(F.col("u") != F.col("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u")
        small = (
            moved.select("u", F.col("m").alias("v"))
            .unionByName(moved.select(F.col("v").alias("u"), F.col("m").alias("v")))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        edges = stored(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            leaves = edges.groupBy("u").agg(F.min("v").alias("root"))
            roots = edges.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct()
            return leaves.unionByName(roots).withColumnRenamed("u", "node")
        state = now
