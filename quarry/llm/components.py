"""Connected components of links as a distributed star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import store


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): root is the smallest node reachable.

    Alternates large and small stars (each node hands its larger, then its smaller, neighbours to
    its smallest one) until nothing changes: a number of rounds that grows with the
    logarithm of the number of nodes. A hub's neighbours are handled by joins on its minimum, never
    gathered.
    """
    edges = store(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u != v").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = store(small.unionByName(root.select("u", F.col("m").alias("v"))).distinct(), "stars")
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")) \
                .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
