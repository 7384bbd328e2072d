"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of the undirected edges (a, b) the smallest
    node it is connected with.

    A round joins every node's larger neighbours to its smallest one, then its
    smaller neighbours and itself; the number of edges never grows, and rounds
    end when the edges are stars around the roots. Minima are taken before the
    shuffle, so a node with very many edges is no hot key in the aggregation,
    and the joins are plain ones, whose large partitions Spark splits."""
    state = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(state)
    while True:
        both = state.unionAll(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = (state.select(F.col("v").alias("w"), F.col("u").alias("far"))  # neighbours larger than w
                 .join(least, "w").select(F.col("far").alias("u"), F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = (large.select(F.col("u").alias("w"), F.col("v").alias("near")).join(least, "w")
                 .filter("near <> m").select(F.col("near").alias("u"), F.col("m").alias("v"))
                 .unionAll(least.select(F.col("w").alias("u"), F.col("m").alias("v")))).distinct()
        state = cut(small)
        new = _mark(state)
        if new == mark:
            roots = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionAll(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = new


def _mark(edges: DataFrame):
    """Number of edges and two sums over them: two equal in a row mean no change."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
    return tuple(row)
