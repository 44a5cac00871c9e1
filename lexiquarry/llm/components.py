"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a partial aggregation and a join; rows are pairs of ids. A hub with very many links is one row of the
aggregate, and its links are the skewed side of a join that AQE splits. Steps end lineage in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected(links: DataFrame) -> DataFrame:
    """links: (a, b) long, any order, repeats and loops allowed. Returns (node, component), component the smallest id
    reachable, for nodes that have a link to another and are not the smallest themselves. Steps
    repeat until nothing changes. No links give no rows."""
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        before, edges = edges, materialize(small, "links")
        discard(before)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
