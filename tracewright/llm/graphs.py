"""Connected components of a large graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import settle


SMALL = 200_000        # edges up to which the smallest neighbours of all nodes (16 bytes each) are broadcast


def _rewired(edges: DataFrame, keep, small: bool) -> DataFrame:
    """Edges from what stands at ``u`` to the smallest node next to it.

    In a large graph the minima are written first, so that hubs can be split in the join.
    """
    lows = edges.groupBy("u").agg(F.min("v").alias("low"))
    near = edges.join(F.broadcast(lows) if small else settle(lows, "lows"), "u")
    return settle(keep(near).where("u <> v").distinct(), "edges")


def _are_stars(edges: DataFrame) -> bool:
    """Every node hangs on one other, and nothing hangs on a node that hangs."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    odd = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 1 or (hangs = 1 and holds = 1)")
    return odd.agg(F.count(F.lit(1))).first()[0] == 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node of its component.

    Alternates two steps until every component is a star: every larger neighbour of a node
    is tied to the smallest node around it, then every smaller one. Each round
    at least halves long paths. Hubs are only aggregated and joined, never
    gathered. Loops and null ends are dropped; repeated edges do no harm.
    """
    edges = settle(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                   .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "edges")
    while not _are_stars(edges):
        small = edges.count() <= SMALL
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = _rewired(both, lambda e: e.where("v > u").select(F.col("v").alias("u"), F.least("low", "u").alias("v")), small)
        edges = _rewired(edges, lambda e: e.select("u", F.col("low").alias("v")).unionByName(e.select(F.col("v").alias("u"), F.col("low").alias("v"))), small)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
