"""Connected components of a graph given by its edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratadoc.session import saved


def _to_smallest(arcs: DataFrame, larger_only: bool) -> DataFrame:
    """Links the neighbours v of each u (those above u, or all) and u itself to the least of u and its neighbours."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    links = arcs.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"), (F.col("v") > F.col("u")).alias("above"))
    links = links.filter("above").drop("above") if larger_only else links.drop("above").unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return links.filter("a > b").distinct()


def components(edges: DataFrame, stars: bool = False) -> DataFrame:
    """edges (a, b) -> node, root: the least node that each node of an edge can reach. Self links don't count.

    Where edges are already stars, many to a node, stars says so and a node's other centres are linked to its least first.

    Edges that already are stars around the least nodes are returned as they are. Every step writes its edges to the shared folder, so that lineage stays short; the steps end when the edges are stars
    around the least nodes, after a number of steps that grows with the logarithm of the longest path.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    if stars:
        now = saved(_to_smallest(now.select(F.col("a").alias("u"), F.col("b").alias("v")), larger_only=False), "edges")
    size = None
    again = now.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a")
    passed = now.select("a").join(now.select(F.col("b").alias("a")), "a", "left_semi")
    if again.unionByName(passed).isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _to_smallest(both, larger_only=True)
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        now = saved(_to_smallest(down, larger_only=False), "edges")
        before, size = size, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if size == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
