"""Import of another origin's changeset under monotonic rules: nothing comes back to life, and only its owner's word ends a node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import RANK
from ..shared import materialise
from . import graph
from .lifecycle import rank_of

COLUMNS = ("uuid", "content", "channel", "label", "conf_label", "status", "tombstoned", "redacted", "origin")
#: The least confidentiality of a node that an origin without trust sends (fixed value).
UNTRUSTED_CONF = 1


def _level(raw: Column, least: int = 0) -> Column:
    """Whatever was sent as a level within [least, 3]; what is no number counts as the least."""
    return F.greatest(F.lit(least), F.least(F.lit(3), F.coalesce(raw.cast("string").try_cast("int"), F.lit(least))))


def import_changeset(nodes: DataFrame, edges: DataFrame, sent: DataFrame, sent_edges: DataFrame, origin: str | None, trusted: bool, redactions: DataFrame) -> dict[str, DataFrame]:
    """nodes, edges and stats of an import, see ``_merge``; then revocations and redactions go down, and the lattices are renewed."""
    merged, wired, stats = _merge(nodes, edges, sent, sent_edges, origin, trusted, redactions)
    return {"nodes": _settle(merged, materialise(wired, "import")), "edges": wired, "stats": stats}


def import_stats(nodes: DataFrame, edges: DataFrame, sent: DataFrame, sent_edges: DataFrame, origin: str | None, trusted: bool, redactions: DataFrame) -> DataFrame:
    """The stats of ``import_changeset`` alone: they count what the merge does, which needs neither closures nor lattices."""
    return _merge(nodes, edges, sent, sent_edges, origin, trusted, redactions)[2]


def _merge(nodes: DataFrame, edges: DataFrame, sent: DataFrame, sent_edges: DataFrame, origin: str | None, trusted: bool, redactions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes (the store after the import, with ``fresh``), edges(child, parent) and stats of nodes (uuid and the other ``COLUMNS``)
    with edges by uuid, and what the origin sent. redactions(uuid) are the records held, with those sent if the origin is trusted.

    New nodes of a trusted origin keep a known channel, whose rank is their label; all others are external and at least internal.
    Redacted nodes carry no content. A known node keeps its values: it is revoked or quarantined if the changeset's origin owns it,
    redacted if that or a record says so. An edge needs two new ends, or a child that the trusted origin owns. Revocations of known
    nodes, and redactions, go on to all that is derived; then live derived nodes take the least label and the greatest
    confidentiality of their live parents. Of several rows with one uuid the least counts; rows without one are skipped."""
    own = F.lit(origin).cast("string")
    one = sent.where("coalesce(uuid, '') <> ''").groupBy("uuid").agg(F.min(F.struct(*(c for c in COLUMNS if c != "uuid"))).alias("i"))
    known = nodes.select("uuid", F.struct(*(c for c in COLUMNS if c != "uuid")).alias("l"))
    held = redactions.select("uuid", F.lit(True).alias("_held")).distinct()
    both = known.join(one, "uuid", "full_outer").join(held, "uuid", "left").withColumn("recorded", F.coalesce("_held", F.lit(False)))
    fresh, came = F.col("l").isNull(), F.col("i").isNotNull()
    owned = F.coalesce(F.col("l.origin") == own, F.lit(False))
    dead, gone = (F.coalesce(F.col(f"i.{c}"), F.lit(0)) != 0 for c in ("tombstoned", "redacted"))
    bad = F.coalesce(F.col("i.status") == "quarantined", F.lit(False))
    channel = F.when(F.lit(trusted) & F.col("i.channel").isin(*RANK), F.col("i.channel")).otherwise("external")
    new = {
        "content": F.when(gone | F.col("recorded"), "").otherwise(F.coalesce("i.content", F.lit(""))), "channel": channel,
        "label": F.when(channel == "agent-derived", _level(F.col("i.label"))).otherwise(rank_of(channel)), "conf_label": _level(F.col("i.conf_label"), 0 if trusted else UNTRUSTED_CONF),
        "status": F.when(bad, "quarantined").otherwise("live"), "tombstoned": dead.cast("int"), "redacted": (gone | F.col("recorded")).cast("int"), "origin": F.col("i.origin"),
    }
    revoked = came & owned & dead & (F.col("l.tombstoned") == 0)
    redacted = came & (F.col("recorded") | gone & owned) & (F.col("l.redacted") == 0)
    held_up = came & owned & bad & (F.col("l.status") == "live")
    old = {c: F.col(f"l.{c}") for c in COLUMNS if c != "uuid"} | {
        "content": F.when(redacted, "").otherwise(F.col("l.content")), "tombstoned": F.when(revoked, 1).otherwise(F.col("l.tombstoned")),
        "redacted": F.when(redacted, 1).otherwise(F.col("l.redacted")), "status": F.when(held_up, "quarantined").otherwise(F.col("l.status")),
    }
    yes = lambda c: F.coalesce(c, F.lit(False))
    blocked = sum(F.when(came & yes(x), 1).otherwise(0) for x in (~dead & (F.col("l.tombstoned") == 1), ~gone & (F.col("l.redacted") == 1), (F.coalesce("i.status", F.lit("live")) == "live") & (F.col("l.status") == "quarantined")))
    merged = both.select(
        "uuid", *(F.when(fresh, new[c]).otherwise(old[c]).alias(c) for c in COLUMNS[1:]), fresh.alias("fresh"), yes(~fresh & (revoked | redacted | held_up)).alias("updated"),
        yes(~fresh & revoked).alias("ends"), yes(F.when(fresh, new["redacted"] == 1).otherwise(redacted)).alias("scrubs"), F.when(fresh, 0).otherwise(blocked).alias("blocked"),
    )
    merged = materialise(merged, "import")
    ends = merged.select("uuid", "fresh", F.coalesce(F.col("origin") == own, F.lit(False)).alias("mine"))
    at = lambda side: ends.select(F.col("uuid").alias(side), F.col("fresh").alias(f"{side}_new"), F.col("mine").alias(f"{side}_mine"))
    allowed = sent_edges.select("child", "parent").distinct().join(at("child"), "child").join(at("parent"), "parent").where((F.col("child_new") & F.col("parent_new")) | (F.lit(trusted) & F.col("child_mine")))
    added = materialise(allowed.select("child", "parent").join(edges, ["child", "parent"], "left_anti"), "import")
    wired = edges.select("child", "parent").unionByName(added)
    count = lambda c: F.sum(F.col(c).cast("long"))
    stats = merged.agg(count("fresh").alias("nodes_new"), count("updated").alias("nodes_updated"), F.sum("blocked").cast("long").alias("resurrections_blocked")).crossJoin(added.agg(F.count("*").alias("edges_new")))
    return merged, wired, stats


def _settle(merged: DataFrame, wired: DataFrame) -> DataFrame:
    """The merged nodes after what was ended or redacted went down the wired edges, with both lattices renewed."""
    below = lambda flag: graph.reachable(wired, merged.where(flag).select(F.col("uuid").alias("id"))).select(F.col("id").alias("uuid"), F.lit(1).alias(f"_{flag}"))
    after = merged.join(below("ends"), "uuid", "left").join(below("scrubs"), "uuid", "left")
    after = after.withColumn("tombstoned", F.when(F.col("_ends") == 1, 1).otherwise(F.col("tombstoned"))).withColumn("content", F.when(F.col("_scrubs") == 1, "").otherwise(F.col("content"))).withColumn("redacted", F.when(F.col("_scrubs") == 1, 1).otherwise(F.col("redacted")))
    after = materialise(after.select(*COLUMNS, "fresh"), "import")
    live = wired.join(after.where("tombstoned = 0").select(F.col("uuid").alias("parent")), "parent", "left_semi")
    out = after
    for column, combine, unresolved in (("label", F.min, 0), ("conf_label", F.max, None)):
        values = after.select(F.col("uuid").alias("id"), F.col(column).cast("int").alias("value"), (F.col("channel") != "agent-derived").alias("fixed"))
        value = graph.lattice(values, live, combine, unresolved).select(F.col("id").alias("uuid"), F.col("value").alias("_v"))
        out = out.join(value, "uuid").withColumn(column, F.when(F.col("tombstoned") == 0, F.col("_v")).otherwise(F.col(column))).drop("_v")
    return out
