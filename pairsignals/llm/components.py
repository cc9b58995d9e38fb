"""Connected components of a graph given as edges, by alternating stars.

Each round hangs the larger neighbours of every node, then the smaller ones,
on the smallest node next to it, until every component is a star around its
smallest node. Edges are only grouped for a minimum (which sums up before the
shuffle) and joined back, so a node with very many edges is split like any
other large key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def star(edges: DataFrame, larger: bool) -> DataFrame:
    """One step over edges (u, v): of the larger or the smaller neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if larger:
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        made = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        below = both.where(F.col("v") < F.col("u"))
        least = below.groupBy("u").agg(F.min("v").alias("m"))
        hung = below.join(least, "u")
        made = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v")))
    return made.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) for every node u that is not the smallest node v of its
    component. ``edges`` has columns u and v, in any direction.

    Each round is checkpointed in the shared folder; of it only a count and a
    checksum reach the driver.
    """
    edges = edges.where(F.col("u") != F.col("v")).distinct().checkpoint()
    before = None
    while True:
        seen = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(seen) == before or not seen[0]:
            return edges
        before = tuple(seen)
        edges = star(star(edges, larger=True), larger=False).checkpoint()
