"""Connected components of a link table by alternating large-star and small-star rounds.

A round moves every link towards the smallest neighbour: no list of neighbours is built, hot nodes are minima
combined before the shuffle, and each round is written to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dialtone.llm.workspace import release, staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node that has a link to another one."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = staged(edges, "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").select(F.explode(F.array(
                F.struct("u", F.col("m").alias("v")),
                F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")),
            )).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        )
        before_edges, edges = edges, staged(small, "links")
        release(before_edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            roots = edges.select(F.col("v").alias("u")).distinct().select("u", F.col("u").alias("v"))
            return edges.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
