"""Connected components by alternating large-star and small-star joins.

Both steps are one map-side combined minimum per vertex and one many-to-one join, so a
vertex with very many links costs a combined row and a split join, never a gathered
neighbour list. Each round is written to the shared folder; the rounds end when a round
changes no edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.scratch import Scratch


def _star(edges: DataFrame, directed: DataFrame, keep_larger: bool) -> DataFrame:
    """One star step. ``directed(u, v)``: neighbours v seen from u."""
    lowest = directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = directed.join(lowest, "u")
    if keep_larger:
        moved = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = lowest.where(F.col("m") != F.col("u")).select("u", F.col("m").alias("v"))
        moved = linked.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)
    return moved.where(F.col("u") != F.col("v")).distinct()


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is linked to the vertex's lowest neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(edges, both, keep_larger=True)


def small_star(edges: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours are linked to the lowest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return _star(edges, down, keep_larger=False)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, component`` for every node of ``edges(u, v)``; the component is its lowest node.

    Null ends and self links are left out; direction and repetition of links do not matter.
    A node that is in no link is in no row: it is its own component. Empty input gives no row.
    """
    current = scratch.cut(
        edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    mark = _mark(current)
    while True:
        current = scratch.cut(small_star(large_star(current)), "edges")
        after = _mark(current)
        if after == mark:
            break
        mark = after
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free sums that change when any edge does."""
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1_000_003)))).first()
    return tuple(row)
