"""Connected components of a link table, by alternating large and small stars.

Each round is a few aggregations and joins; its result is written to the shared
folder, so neither lineage nor driver grows with the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge downward, to a node that has none."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a > b, distinct -> the same after one star step."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # a table of its own, so that the join can split the rows of a large component's centre
        low = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "low")
        # neighbours above the centre move to its least neighbour
        out = edges.select(F.col("b").alias("a"), F.col("a").alias("v")).join(low, "a").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = moved.union(low.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def _downward(links: DataFrame) -> DataFrame:
    return links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def merged(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, label) after one pair of star steps: nodes of one
    label are connected, but a component may still have several labels."""
    edges = _star(_star(materialise(_downward(links), "links"), True), False)
    return materialise(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")), "labels")


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, component) for every linked node but the least of
    each component, which is the component's name."""
    edges = materialise(_downward(links), "links")
    while not _settled(edges):
        old, edges = edges, materialise(_star(_star(edges, True), False), "stars")
        discard(old)
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out.folder_ = edges.folder_
    return out
