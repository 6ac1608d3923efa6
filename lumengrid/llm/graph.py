"""Connected components over a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, written


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of longs to ``(node, root)``, root the smallest node reachable; only linked nodes appear.

    Alternating large and small stars: every step replaces links by links to
    the least neighbour, through minima that combine before the shuffle, so a
    node with very many links is never gathered.  It ends when the links are
    stars: each node has one smaller neighbour or only greater ones.  Loops,
    repeated links and empty input are fine; links with nulls are ignored.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, "links")
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")
    while not edges.select(ends).select("e.*").groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("low")).filter("up > 1 or up = 1 and low = 0").isEmpty():
        # large star: neighbours greater than a node move to the least of its neighbours and itself
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: the smaller neighbours of a node, and the node, move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        last, edges = edges, written(small.filter("u <> v").distinct(), "links")
        release(last)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
