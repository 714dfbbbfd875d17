"""Connected components over an edge table of any size.

Alternating large-star and small-star rounds: each node links its larger neighbours to its least neighbour, then its
smaller ones, until nothing changes; the result is a star around the least id of each component. The rounds grow with the
logarithm of the size. Every round is a combinable minimum, and a join that gives each edge its node's minimum. Nodes with a
large share of all edges, of which there are few, meet theirs through a broadcast of proven size (``skew``), so no task
gathers a hub's edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import discard, materialise
from .skew import hubs, join_by_share

#: Edges of which any number may be one node's: a task's rows.
FEW = 20_000

def _star(edges: DataFrame, large: bool, hot: list) -> DataFrame:
    """edges(a, b) with a > b; one star step. ``hot``: nodes with a large share of the edges."""
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = join_by_share(near.where("v > u"), least, "u", hot).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = join_by_share(edges, least, "a", hot).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def _hot(edges: DataFrame, total: int) -> list:
    """Nodes with a large share of the edges; a star step makes no node larger in the role in which it is joined."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("u")).groupBy("u").agg(F.count("*").alias("d"))
    return hubs(ends, "u", "d", total) if total > FEW else []


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """(id, component) for every id on an edge between two different ids; the component is its least id."""
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    now = materialise(now, "components")
    seen, total = None, now.count()
    for _ in range(max_rounds):
        hot = _hot(now, total)
        before, now = now, materialise(_star(_star(now, True, hot), False, hot), "components")
        discard(before)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        total = mark[0]
        if seen == mark:
            break
        seen = mark
    else:
        raise RuntimeError("connected components did not settle")
    stars = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
