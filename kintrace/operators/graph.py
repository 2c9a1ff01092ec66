"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kintrace.sources.shared import cut


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select(F.col("v"), F.col("u")))
    low = both.groupBy("x").agg(F.min("y").alias("low"))
    hub = F.least("x", "low")
    return both.join(low, "x").filter("y > x").select(F.col("y").alias("u"), hub.alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("low"))
    moved = e.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v")
    return moved.union(low).distinct()


def _stars(e: DataFrame) -> bool:
    """Whether every node either has one edge, to a root, or is a root."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the least node reachable.

    Each round shuffles the edges twice and is written to the shared folder, so
    lineage stays short. Edges shrink to one star per component in a number of
    rounds that grows with the logarithm of the graph, not with its diameter.
    Null ends are ignored; a node whose only edge is to itself is its own component.
    """
    pairs = edges.select(F.col(a).alias("p"), F.col(b).alias("q")).filter("p is not null and q is not null")
    e = cut(pairs.select(F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v")).distinct(), "edges")
    loops = e.filter("u = v").select("u", F.col("u").alias("v"))
    e = e.filter("u <> v")
    while not _stars(e):
        e = cut(_small_star(_large_star(e)), "edges")
    roots = e.select(F.col("v").alias("u"), "v").distinct()
    return e.union(roots).union(loops).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
