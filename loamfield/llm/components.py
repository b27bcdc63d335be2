"""Connected components of a large link table, by alternating large and small stars.

Each round is two joins and two aggregations on node ids; the number of rounds grows with
the logarithm of the longest path.  Links stay distributed and every round is cut off by a
table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _star(both: DataFrame, large: bool) -> DataFrame:
    """Links (u, v) replaced by links to the smallest neighbour: of the larger neighbours of u, or of u and its smaller ones."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.where("v > u") if large else both.where("v < u")
    out = moved.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every end of ``links`` (a, b); component is the smallest node id reachable.

    Links may repeat, run either way or join a node to itself; nulls are left out.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL")
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    for _ in range(most_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, True)
        # Only pairs (larger, smaller) matter to the small star: its nodes are the larger ends.
        small = _star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False)
        edges = written(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state is not None and tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return ends.join(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")), "node", "left").select("node", F.coalesce("b", "node").alias("component"))
