"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import _io


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every id in links (columns a, b: long).

    Each round points nodes at the least neighbour they know of, from both
    sides, until nothing changes; rounds grow with the logarithm of a
    component's diameter. A round's links are written to the shared folder. The
    least neighbour of a node is found by an aggregation that combines before
    the shuffle, so a node with very many links is no bottleneck. Nulls and
    links of a node to itself are ignored.
    """
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    known = None
    while True:
        pairs = _io.checkpoint(pairs)
        seen = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == known or not seen[0]:
            return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(pairs.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
        known = seen
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        pairs = small.union(least.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
