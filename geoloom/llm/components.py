"""Connected components of a graph given by its edges, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of one orderable type; returns (node, root) for every node of an edge: root is the smallest node reachable.

    Alternates the large-star and the small-star step, each a grouping and a join, until the edges don't
    change. Every round is written to the shared folder. Loops and repeated edges are allowed; rows with a
    null are left out; no edges give no rows.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("root").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("root"))
        small = large.join(least, "a").where("b <> root").select(F.col("b").alias("a"), F.col("root").alias("b"))
        now = saved(small.union(least).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        new = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if new == state:
            break
        state = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
