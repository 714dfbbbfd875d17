"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in ``SHARE`` rows is a hub: there are ``SHARE`` of them at most, whatever the input.
SHARE = 200


def hubs(counts: DataFrame, key: str, count: str, total: int) -> list:
    """The keys of counts(key, count) with a large share of ``total`` rows."""
    return [r[0] for r in counts.where(F.col(count) > total / SHARE).select(key).collect()]


def join_by_share(rows: DataFrame, side: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """rows with the columns of side, which has each key once. The hubs, given as ``hot``, meet their rows through a broadcast of
    as many rows; all others are shuffled, and of a left join rows with a null key are not."""
    hub = F.col(key).isin(hot) if hot else F.lit(False)
    known = rows.where(F.col(key).isNotNull()) if how == "left" else rows
    out = known.where(~hub).join(side.where(~hub), key, how) if hot else known.join(side, key, how)
    if hot:
        out = out.unionByName(known.where(hub).join(F.broadcast(side.where(hub)), key, how))
    return out.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True) if how == "left" else out
