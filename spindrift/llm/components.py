"""Connected components of an edge list by alternating large and small stars.

Each round is two shuffles of the edges; the number of rounds grows with the
logarithm of the longest path.  Nothing is gathered on the driver but two
numbers a round, and every round's edges are written to the shared folder, so
a lost executor costs one round at most.  Their count decides whether the least
neighbours are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, shuffled, written

BROADCAST_EDGES = 50_000


def _star(edges: DataFrame, smaller_only: bool, few: bool) -> DataFrame:
    """One star step over edges (u, v) with v < u; it gives no more edges than it gets."""
    both = edges if smaller_only else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    joined = both.join(F.broadcast(least) if few else shuffled(least), "u")
    if smaller_only:
        # every smaller neighbour, and the node itself, hangs on the least
        stars = joined.select(F.col("v").alias("a"), F.col("low").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("low").alias("b")))
    else:
        stars = joined.where("v > u").select(F.col("v").alias("a"), F.col("low").alias("b"))
    return stars.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)`` (long); root is the least node of its component.

    Self-loops, repeated and reversed edges are allowed; nodes without edges
    are not returned; an empty input gives an empty result.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    seen = now.agg(F.count("*"), mark).first()
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        few = seen[0] <= BROADCAST_EDGES
        after = written(_star(_star(now, False, few), True, few), "edges")
        found = after.agg(F.count("*"), mark).first()
        discard(now)
        now = after
        if tuple(found) == tuple(seen):
            break
        seen = found
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
