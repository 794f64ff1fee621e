"""Connected components by alternating large and small stars, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import written


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest node reached.

    Every step turns the links into stars around smaller nodes; it ends when a step changes nothing. Hot nodes
    are reduced by partial minima before the shuffle, and the join back is one that Spark can split. Null ends and
    links of a node to itself are left out; repeated links are one; no links give no rows."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edges, before = written(edges, "edges"), None
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = written(small.where("u > v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
    raise RuntimeError("components did not settle")
