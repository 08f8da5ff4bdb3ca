"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


EDGES = 500_000  # in a partition, about


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(parts)
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts)


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts)
    tied = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts)
    return tied.unionByName(least.withColumnRenamed("m", "v"))


def components(edges: DataFrame) -> DataFrame:
    """From edges (u, v) between whole numbers: (node, root), the smallest node of its component.

    Edges may repeat, go either way or lead to their own node; nodes without an edge to another
    don't occur in the result, nor do edges with a null end or an empty table's.  Both steps shrink every node's neighbourhood towards the smallest
    number, so the rounds follow the logarithm of the number of nodes, and no task or driver ever
    holds a component.  The partitions follow the number of edges, so that few edges don't leave
    many small files in each round.
    """
    first = saved(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    parts = first.count() // EDGES + 8
    now, state = first.coalesce(parts).distinct(), None
    while True:
        now = saved(now.coalesce(parts))
        look = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(look) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(look)
        now = _small_star(_large_star(now, parts), parts).distinct()
