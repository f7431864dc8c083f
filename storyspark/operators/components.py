"""Connected components of an edge table, as alternating star contractions.

Large-star links every larger neighbour of a node to the smallest node it knows; small-star does so
for the smaller neighbours (Kiveris et al. 2014). Each step is a grouped minimum with map-side
combine and one equi-join, so a hub with a third of all edges costs its partial minimum, and the
join on it is one that adaptive execution splits. Rounds grow with the logarithm of the longest
path. Every round is written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyspark.plans.cutting import discard, materialize


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """One step over edges (u > v): to the least neighbour-or-self of each node."""
    arcs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else edges
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = arcs.join(least, "u")
    if both:
        moved = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u > v").distinct()


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; component is the least node reachable.

    ``left`` and ``right`` are columns of one orderable type. Null ends and loops are ignored,
    repeated edges count once, an empty table gives an empty result.
    """
    now = materialize(
        edges.filter(F.col(left) != F.col(right)).select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct(),
        "edges",
    )
    mark = None
    for _ in range(max_rounds):
        after = materialize(_star(_star(now, True), False), "edges")
        discard(now)
        now = after
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
