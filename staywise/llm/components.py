"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.session import stage


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has a link.

    Links are undirected.  Each round hangs the larger neighbours of every
    node under its smallest one, then the smaller ones; the minimum per node is
    combined before the shuffle and joined back.  All links of a node meet at
    one key of that join; those of a node with very many are split over tasks
    by Spark's skew join (adaptive execution, on by default).  Rounds grow with
    the logarithm of the number of nodes; each is written to the shared folder.
    """
    a, b = F.col(left), F.col(right)
    edges = stage(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.where("u <> v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("s")).select("s.*")
        edges = stage(small.where("u <> v").distinct(), "small-star")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
