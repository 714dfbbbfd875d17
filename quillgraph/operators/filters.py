"""The untainted pool and its relatives, as one predicate that every read path shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def untainted(clearance: int | None = None, include_quarantined: bool = False) -> Column:
    """Not revoked, quarantined, redacted or archived; within the clearance if one is given. Staleness is not part of it."""
    c = (F.col("tombstoned") == 0) & (F.col("redacted") == 0) & (F.col("archived") == 0)
    if not include_quarantined:
        c &= F.col("status") != "quarantined"
    return c & (F.col("conf_label") <= clearance) if clearance is not None else c


def ask_pool(nodes: DataFrame, clearance: int | None = None, min_integrity: int | None = None) -> DataFrame:
    pool = nodes.where(untainted(clearance) & (F.col("channel") != "agent-derived"))
    return pool if min_integrity is None else pool.where(F.col("label") >= min_integrity)


def indexed(nodes: DataFrame) -> DataFrame:
    """What the retrieval index holds: sources that are live, not redacted, not archived; quarantined ones included."""
    return nodes.where((F.col("tombstoned") == 0) & (F.col("redacted") == 0) & (F.col("archived") == 0) & (F.col("channel") != "agent-derived"))


def exclusion_reason(clearance: int) -> Column:
    """Why a source is outside the pool; null if it is inside. The first reason counts."""
    return (
        F.when(F.col("tombstoned") == 1, "tombstoned").when(F.col("status") == "quarantined", "quarantined").when(F.col("redacted") == 1, "redacted")
        .when(F.col("archived") == 1, "archived").when(F.col("conf_label") > clearance, "clearance")
    )


def node_state() -> Column:
    parts = F.filter(F.array(F.when(F.col("tombstoned") == 1, "tombstoned"), F.when(F.col("redacted") == 1, "redacted"), F.when(F.col("status") == "quarantined", "quarantined")), lambda x: x.isNotNull())
    return F.when(F.size(parts) == 0, "live").otherwise(F.array_join(parts, "+"))
