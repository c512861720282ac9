"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import BROADCAST_ROWS, bounded_broadcast, discard, materialize


def _minima(edges: DataFrame, few: bool) -> DataFrame:
    """(a, m): least neighbour of each node. Beyond ``few`` edges it is written first, so that
    the join with it can be a broadcast of checked size or can split the edges of a node
    with very many."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return least if few else bounded_broadcast(materialize(least, "minima"))


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _minima(both, few).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    least = _minima(edges, few)
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the component's least node.

    Each round writes its edges, pre-aggregates minima before shuffling, and compares
    two sums to see whether anything moved. It ends at the fixed point, in rounds of the
    order of the square of the logarithm of the nodes. Self-loops and repeated edges do no harm.
    """
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    few = now.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    mark = None
    while True:
        before = now
        wide = _large_star(before, few)
        wide = wide if few else materialize(wide, "stars")
        now = materialize(_small_star(wide, few), "edges")
        discard(before, wide)
        seen = tuple(
            now.agg(
                F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))
            ).first()
        )
        if seen == mark:
            break
        mark = seen
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
