"""Connected components of a graph given by its edges, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for nodes that have an edge. ``edges``: columns a, b.

    Alternates large-star and small-star steps until the edges are stars. A step is a grouped minimum,
    summed before the shuffle, and a join that Spark may split where a hub is large; every step's edges
    are written to the shared folder.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = scratch.table(now, "edges")
    before = _state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("m"))
        large = both.join(least, both.a == least.v).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.table(large, "large-star")
        least = large.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
        met = large.join(least, large.a == least.v)
        small = met.select("a", F.col("m").alias("b")).unionByName(met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        now = scratch.table(small, "small-star")
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
