"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmine.llm.common import settle


def _lowest(edges: DataFrame) -> DataFrame:
    """Lowest of a node and its listed neighbours, combined before the shuffle."""
    return edges.groupBy("u").agg(F.least("u", F.min("v")).alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.selectExpr("v AS u", "u AS v"))
    return both.join(_lowest(both), "u").where("v > u AND v <> low").selectExpr(
        "v AS u", "low AS v"
    ).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.selectExpr("greatest(u, v) AS u", "least(u, v) AS v")
    low = _lowest(down)
    moved = down.join(low, "u").where("v <> low").selectExpr("v AS u", "low AS v")
    return moved.union(low.selectExpr("u", "low AS v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node with an edge; ``component`` is its lowest node.

    ``edges`` has columns ``u`` and ``v``.  Alternates large-star and small-star until every node
    points at the lowest of its component, which takes about as many rounds as the logarithm of the
    longest path.  Each round is written to the shared folder.  A node with very many neighbours is a
    skewed join key, which adaptive execution splits; its lowest neighbour is found by a combined sum.
    """
    now = settle(edges.where("u <> v").select("u", "v").distinct(), "edges")
    mark = None
    while True:
        now = settle(_small_star(_large_star(now)), "edges")
        new = now.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)
        ).first()
        if new == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.selectExpr("v AS node", "v AS component").distinct()
            )
        mark = new
