"""Connected components of links by alternating large and small stars, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written


def components(links: DataFrame, keep: Written, name: str) -> DataFrame:
    """(node, root) for each node that links (a, b) name, root the smallest node it can reach.

    Each round replaces a node's links by links to its smallest neighbour; a node with very many links is summed up
    before it is shuffled, and no neighbour list is ever gathered. Rounds grow with the logarithm of the nodes; each
    is written, so a lost executor costs one round at most. Links of a node to itself and repeated links do no harm.
    """
    put = lambda df, i: keep.put(df.distinct(), f"{name}-{i}")
    edges = put(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), 0)
    sign = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0])
    before, i = None, 0
    while (now := sign(edges)) != before:
        before, i = now, i + 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = put(small.select("e.u", "e.v").filter("u <> v"), i)
        keep.drop(f"{name}-{i - 1}")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
