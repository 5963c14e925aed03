"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Workspace


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of every node (large: the greater ones, both ways) on its least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(edges: DataFrame, work: Workspace, name: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; the component is its least node.

    Edges between equal or null nodes are ignored. A round keeps the component
    of every node and at least halves the depth of the trees; it ends when the
    stars no longer change.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = work.keep(edges, f"{name}-0")
    before = None
    for k in range(1, most_rounds + 1):
        edges = work.keep(_star(_star(edges, True), False), f"{name}-{k}")
        work.drop(f"{name}-{k - 1}")
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = tuple(row)
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
