"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import drop_scratch, scratch


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component.

    Each round joins the edges with their nodes' smallest neighbours; no group is gathered, so a hub with
    very many edges is only a skewed join key, which adaptive execution splits. Every round is written to
    the shared folder, so that a lost executor costs one round. Edges of a node to itself, edges that
    repeat and edges with a null end give no links.
    """
    def told(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def smallest(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.min(value).alias(name))

    start = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a != b").distinct()
    now = scratch(start, "edges")
    seen = told(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = smallest(both, "a", "b", "m").select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        # large star: every larger neighbour v of u is tied to the smallest of u and its neighbours
        large = both.join(least, both["a"] == least["u"]).filter("b > u").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        # small star: the smaller neighbours of u, and u, are tied to the smallest of them
        low = smallest(large, "a", "b", "m").select(F.col("a").alias("u"), "m")
        small = large.join(low, large["a"] == low["u"]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
        after = scratch(small.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        drop_scratch(now)
        now, before, seen = after, seen, told(after)
        if seen == before:
            break
    roots = now.groupBy("b").agg(F.lit(1).alias("one")).select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
