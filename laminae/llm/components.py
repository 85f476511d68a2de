"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import compact


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour, or to the node."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    tied = edges.join(least, "u").select(F.explode(F.array(pair("u", "m"), pair("v", "m"))).alias("e"))
    return tied.select("e.u", "e.v").filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the least node reachable) for the nodes of ``a, b``; loops are ignored.

    A step keeps two rows an edge at most and is written out. A node with a third of all edges is
    summed in each task first; in the join that follows its edges meet in one task, as adaptive
    execution does not split a shuffle that an aggregation shares (see the README).
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    edges, _ = compact(edges)
    state = _state(edges)
    while True:
        edges, _ = compact(_small_star(compact(_large_star(edges))[0]))
        was, state = state, _state(edges)
        if was == state:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
