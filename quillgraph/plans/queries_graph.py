"""Graph, lattice, pool and gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, graph
from ..operators.components import connected_components
from ..shared import materialise
from .views import Store

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    """Register a query over a Store, and its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def shared(name: str, sql: str) -> None:
    """A relational query whose one text both engines run."""
    query(name, sql)(lambda s: s.sql(sql))


POOL = "tombstoned = 0 AND redacted = 0 AND archived = 0 AND status <> 'quarantined'"
COLS = "id, channel, label, conf_label"


@query("pool_untainted", f"SELECT {COLS} FROM {{nodes}} WHERE {POOL} AND conf_label <= 2")
def _(s):
    return s.nodes.where(filters.untainted(2)).select("id", "channel", "label", "conf_label")


shared("live_sources", "SELECT id, channel, label, source_ref FROM {src} WHERE tombstoned = 0")


@query("ask_pool", f"SELECT {COLS} FROM {{nodes}} WHERE {POOL} AND channel <> 'agent-derived' AND conf_label <= 1")
def _(s):
    return filters.ask_pool(s.nodes, 1).select("id", "channel", "label", "conf_label")


@query("retrieve_pool", f"SELECT id FROM {{nodes}} WHERE {POOL} AND channel <> 'agent-derived' AND label >= 2")
def _(s):
    return filters.ask_pool(s.nodes, min_integrity=2).select("id")


shared("untainted_derived", f"SELECT id, label, source_ref FROM {{der}} WHERE {POOL} AND label > 0")
shared("untainted_sources", f"SELECT id, label, source_ref FROM {{src}} WHERE {POOL}")
shared("clearance_sources", "SELECT id, channel, conf_label FROM {src} WHERE tombstoned = 0 AND archived = 0 AND conf_label <= 1")
shared("live_unquarantined_sources", "SELECT id, channel FROM {src} WHERE tombstoned = 0 AND status <> 'quarantined'")
shared("live_unredacted_sources", "SELECT id, channel FROM {src} WHERE tombstoned = 0 AND redacted = 0")
shared("fresh_only", f"SELECT id FROM {{nodes}} WHERE {POOL} AND stale = 0")
shared("list_quarantined", "SELECT id, channel, label FROM {nodes} WHERE status = 'quarantined' AND tombstoned = 0")
shared("list_archived", "SELECT id, channel FROM {nodes} WHERE archived = 1")
shared("dump_nodes", "SELECT n.id, n.channel, n.label, n.tombstoned, count(e.parent) AS n_parents FROM {nodes} n LEFT JOIN {edges} e ON e.child = n.id GROUP BY n.id, n.channel, n.label, n.tombstoned")


@query("exclusion_counts", """
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN tombstoned = 1 THEN 'tombstoned' WHEN status = 'quarantined' THEN 'quarantined' WHEN redacted = 1 THEN 'redacted'
  WHEN archived = 1 THEN 'archived' WHEN conf_label > 1 THEN 'clearance' END AS reason FROM {src}) x WHERE reason IS NOT NULL GROUP BY reason""")
def _(s):
    return s.src.select(filters.exclusion_reason(1).alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


STATE = """CASE WHEN tombstoned = 0 AND redacted = 0 AND status <> 'quarantined' THEN 'live' ELSE
  concat_ws('+', CASE WHEN tombstoned = 1 THEN 'tombstoned' END, CASE WHEN redacted = 1 THEN 'redacted' END, CASE WHEN status = 'quarantined' THEN 'quarantined' END) END"""


@query("node_state", f"SELECT id, {STATE} AS state FROM {{nodes}}")
def _(s):
    return s.nodes.select("id", filters.node_state().alias("state"))


# --- edges ---------------------------------------------------------------------------------------------------------------

shared("parents_of", "SELECT e.child, n.id AS parent, n.label, n.channel FROM {edges} e JOIN {nodes} n ON n.id = e.parent")


@query("dangling_edges", "SELECT DISTINCT child, parent FROM (SELECT child, parent FROM {edges} UNION ALL SELECT -1, -2) e WHERE child NOT IN (SELECT id FROM {nodes}) OR parent NOT IN (SELECT id FROM {nodes})")
def _(s):
    probe = s.spark.range(1).select(F.lit(-1).cast("long").alias("child"), F.lit(-2).cast("long").alias("parent"))
    return dangling(s.edges.unionByName(probe), s.nodes)


def dangling(edges, nodes):
    ids = nodes.select("id")
    return edges.join(ids, edges["child"] == ids["id"], "left_anti").union(edges.join(ids, edges["parent"] == ids["id"], "left_anti")).distinct()


shared("live_child_dead_parent", "SELECT DISTINCT e.child FROM {edges} e JOIN {nodes} c ON c.id = e.child JOIN {nodes} p ON p.id = e.parent WHERE c.tombstoned = 0 AND p.tombstoned = 1")
shared("consolidated_ids", "SELECT e.child AS id FROM {edges} e JOIN {nodes} p ON p.id = e.parent GROUP BY e.child HAVING min(p.archived) = 1")
shared("link_pairs", "SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM {rel} WHERE a <> b")
shared("derive_floor", "SELECT e.child AS id, min(p.label) AS floor, count(*) AS n_parents, sum(p.tombstoned) AS dead_parents FROM {edges} e JOIN {nodes} p ON p.id = e.parent GROUP BY e.child")
shared("derive_conf", "SELECT d.id, coalesce(max(CASE WHEN p.tombstoned = 0 THEN p.conf_label END), 0) AS conf FROM {der} d LEFT JOIN {edges} e ON e.child = d.id LEFT JOIN {nodes} p ON p.id = e.parent GROUP BY d.id")

SEEDS = "SELECT id FROM {src} WHERE stale = 1 AND channel = 'external'"
DOWN = f"WITH RECURSIVE reach AS (SELECT id FROM ({SEEDS}) s UNION SELECT e.child FROM reach r JOIN {{edges}} e ON e.parent = r.id)"


def _seeds(s):
    return s.src.where("stale = 1 and channel = 'external'").select("id")


@query("cascade_set", f"{DOWN} SELECT id FROM reach")
def _(s):
    return graph.reachable(s.edges, _seeds(s))


@query("revoke_cascade", f"""{DOWN} SELECT n.id, CASE WHEN n.id IN ({SEEDS}) THEN 'revoked' ELSE 'derived from a revoked source' END AS reason
  FROM {{nodes}} n JOIN reach r ON r.id = n.id WHERE n.tombstoned = 0""")
def _(s):
    return _marked(s, "tombstoned", "revoked", "derived from a revoked source")


def _marked(s, flag, own, below):
    """Only nodes whose flag is still 0 change: the first reason wins."""
    seeds = _seeds(s)
    hit = s.nodes.where(F.col(flag) == 0).join(graph.reachable(s.edges, seeds), "id", "left_semi")
    return hit.join(seeds.withColumn("_seed", F.lit(True)), "id", "left").select("id", F.when(F.col("_seed"), own).otherwise(below).alias("reason"))


@query("stale_cascade", f"""{DOWN} SELECT n.id, CASE WHEN n.id IN ({SEEDS}) THEN 'source changed' ELSE 'built on a changed source' END AS reason
  FROM {{nodes}} n JOIN reach r ON r.id = n.id WHERE n.stale = 0""")
def _(s):
    return _marked(s, "stale", "source changed", "built on a changed source")


@query("redact_cascade", f"{DOWN} SELECT n.id, '' AS content, n.redacted AS was_redacted FROM {{nodes}} n JOIN reach r ON r.id = n.id")
def _(s):
    return s.nodes.join(graph.reachable(s.edges, _seeds(s)), "id", "left_semi").select("id", F.lit("").alias("content"), F.col("redacted").alias("was_redacted"))


UP = "WITH RECURSIVE anc AS (SELECT child AS seed, parent AS id FROM {edges} UNION SELECT a.seed, e.parent FROM anc a JOIN {edges} e ON e.child = a.id)"


def _ancestors(s):
    return graph.closure(s.edges, s.edges.select(F.col("child").alias("id")), "child", "parent", include_seed=False)


@query("ancestors", f"{UP} SELECT seed, id FROM anc")
def _(s):
    return _ancestors(s)


ROOTS = f"{UP}, blamed AS (SELECT a.seed, n.* FROM anc a JOIN {{nodes}} n ON n.id = a.id WHERE n.channel <> 'agent-derived' UNION ALL SELECT n.id AS seed, n.* FROM {{src}} n)"


def _blamed(s):
    roots = s.nodes.where("channel <> 'agent-derived'")
    own = s.src.select(F.col("id").alias("seed"), *s.nodes.columns)
    return _ancestors(s).join(roots, "id").select("seed", *s.nodes.columns).unionByName(own)


@query("blame", f"""WITH RECURSIVE {UP[len('WITH RECURSIVE '):]}, blamed AS (SELECT a.seed, n.id, n.channel, n.label, n.conf_label, n.tombstoned, n.redacted, n.status FROM anc a JOIN {{nodes}} n ON n.id = a.id WHERE n.channel <> 'agent-derived'
  UNION ALL SELECT id, id, channel, label, conf_label, tombstoned, redacted, status FROM {{src}})
  SELECT seed, id, CASE WHEN conf_label > 2 THEN '[above clearance]' ELSE channel END AS channel, label, {STATE} AS state FROM blamed""")
def _(s):
    """Every root behind a node, dead ones included; a source is its own root."""
    return _blamed(s).select("seed", "id", F.when(F.col("conf_label") > 2, "[above clearance]").otherwise(F.col("channel")).alias("channel"), "label", filters.node_state().alias("state"))


BLAMED = f"""{UP}, blamed AS (SELECT a.seed, n.id, n.channel, n.label, n.tombstoned, n.redacted FROM anc a JOIN {{nodes}} n ON n.id = a.id WHERE n.channel <> 'agent-derived'
  UNION ALL SELECT id, id, channel, label, tombstoned, redacted FROM {{src}})"""


@query("profile", f"""{BLAMED} SELECT seed, label, count(*) AS n_leaves, sum(CASE WHEN channel = 'external' THEN 1 ELSE 0 END) AS n_external, min(id) AS first_leaf FROM blamed
  WHERE tombstoned = 0 AND redacted = 0 GROUP BY seed, label""")
def _(s):
    leaves = _blamed(s).where("tombstoned = 0 and redacted = 0")
    return leaves.groupBy("seed", "label").agg(F.count("*").alias("n_leaves"), F.sum(F.when(F.col("channel") == "external", 1).otherwise(0)).alias("n_external"), F.min("id").alias("first_leaf"))


TAINT = """WITH RECURSIVE ext AS (SELECT e.child AS id FROM {edges} e JOIN {nodes} p ON p.id = e.parent WHERE p.channel = 'external' AND p.tombstoned = 0
  UNION SELECT e.child FROM ext x JOIN {edges} e ON e.parent = x.id)"""


def tainted_by(s, channel: str):
    """Ids below a live node of a channel: one propagation downwards instead of a closure for each node."""
    live = s.nodes.where((F.col("channel") == channel) & (F.col("tombstoned") == 0)).select("id")
    first = s.edges.join(live, s.edges["parent"] == live["id"]).select(F.col("child").alias("id")).distinct()
    return graph.reachable(s.edges, first)


@query("external_tainted", f"{TAINT} SELECT id FROM ext")
def _(s):
    return tainted_by(s, "external")


GATE = f"""{TAINT} SELECT d.id, CASE WHEN d.label = 0 THEN 'integrity=EXTERNAL' ELSE 'live external ancestor' END AS cause
  FROM {{der}} d WHERE d.tombstoned = 0 AND d.status = 'live' AND d.id NOT IN (SELECT id FROM {{elevations}}) AND (d.label = 0 OR d.id IN (SELECT id FROM ext))"""


@query("consolidate_gate", GATE)
def _(s):
    """Derived nodes to quarantine; lifted and elevated ones are exempt."""
    open_ = s.der.where("tombstoned = 0 and status = 'live'").join(s.elevations.select("id"), "id", "left_anti")
    bad = tainted_by(s, "external").withColumn("_t", F.lit(True))
    cause = F.when(F.col("label") == 0, "integrity=EXTERNAL").when(F.col("_t"), "live external ancestor")
    return open_.join(bad, "id", "left").select("id", cause.alias("cause")).where("cause is not null")


@query("promote_eligible", f"""{TAINT}, en AS (SELECT e.child AS id FROM {{edges}} e JOIN {{nodes}} p ON p.id = e.parent WHERE p.channel = 'endorsed' AND p.tombstoned = 0
  UNION SELECT e.child FROM en x JOIN {{edges}} e ON e.parent = x.id) SELECT id FROM {{der}} WHERE tombstoned = 0 AND id IN (SELECT id FROM en) AND id NOT IN (SELECT id FROM ext)""")
def _(s):
    return s.der.where("tombstoned = 0").select("id").join(tainted_by(s, "endorsed"), "id", "left_semi").join(tainted_by(s, "external"), "id", "left_anti")


# --- lattices ------------------------------------------------------------------------------------------------------------

LIVE = "live AS (SELECT DISTINCT e.child, e.parent FROM {edges} e JOIN {nodes} p ON p.id = e.parent WHERE p.tombstoned = 0)"
LABELS = f"""WITH RECURSIVE {LIVE},
  fixed AS (SELECT id, label FROM {{src}} UNION ALL SELECT id, to_label FROM {{elevations}} UNION ALL
    SELECT id, label FROM {{der}} WHERE id NOT IN (SELECT child FROM live) AND id NOT IN (SELECT id FROM {{elevations}})),
  up AS (SELECT id AS seed, id FROM {{nodes}} UNION SELECT u.seed, l.parent FROM up u JOIN live l ON l.child = u.id WHERE u.id NOT IN (SELECT id FROM fixed)),
  eff AS (SELECT u.seed AS id, min(f.label) AS label FROM up u JOIN fixed f ON f.id = u.id GROUP BY u.seed)"""


def effective_labels(s):
    """MIN over the live provenance; sources and elevated nodes are fixed points; a cycle gives 0."""
    live = s.edges.join(s.nodes.where("tombstoned = 0").select(F.col("id").alias("parent")), "parent", "left_semi")
    lifted = s.elevations.groupBy("id").agg(F.max("to_label").alias("to_label"))
    values = s.nodes.join(lifted, "id", "left").select("id", F.coalesce("to_label", "label").cast("int").alias("value"), ((F.col("channel") != "agent-derived") | F.col("to_label").isNotNull()).alias("fixed"))
    return graph.lattice(values, live, F.min, unresolved=0).select("id", F.col("value").alias("label"))


@query("effective_labels", f"{LABELS} SELECT id, label FROM eff")
def _(s):
    return effective_labels(s)


@query("recompute_changes", f"{LABELS} SELECT n.id, n.label AS stored, eff.label AS effective FROM {{nodes}} n JOIN eff ON eff.id = n.id WHERE eff.label <> n.label")
def _(s):
    return s.nodes.select("id", F.col("label").alias("stored")).join(effective_labels(s).select("id", F.col("label").alias("effective")), "id").where("stored <> effective")


CONFS = f"""WITH RECURSIVE {LIVE}, up AS (SELECT id AS seed, id FROM {{nodes}} UNION SELECT u.seed, l.parent FROM up u JOIN live l ON l.child = u.id),
  eff AS (SELECT u.seed AS id, max(n.conf_label) AS conf FROM up u JOIN {{nodes}} n ON n.id = u.id WHERE n.channel <> 'agent-derived' OR n.id NOT IN (SELECT child FROM live) GROUP BY u.seed)"""


def effective_confs(s):
    """MAX over the live provenance of derived nodes; on a cycle the fixpoint over its members and what reaches it."""
    live = s.edges.join(s.nodes.where("tombstoned = 0").select(F.col("id").alias("parent")), "parent", "left_semi")
    values = s.nodes.select("id", F.col("conf_label").alias("value"), (F.col("channel") != "agent-derived").alias("fixed"))
    return graph.lattice(values, live, F.max, unresolved=None).select("id", F.col("value").alias("conf"))


@query("effective_confs", f"{CONFS} SELECT id, conf FROM eff")
def _(s):
    return effective_confs(s)


@query("check_action", f"""{BLAMED}, weak AS (SELECT seed, id, row_number() OVER (PARTITION BY seed ORDER BY label, id) AS n FROM blamed WHERE tombstoned = 0)
  SELECT n.id, CASE WHEN n.label >= 2 THEN 'allow' ELSE 'deny' END AS decision, n.label AS floor, CASE WHEN n.label < 2 THEN w.id END AS culprit
  FROM {{nodes}} n LEFT JOIN weak w ON w.seed = n.id AND w.n = 1""")
def _(s):
    """Floor against the required rank; a denial names the weakest live leaf."""
    weak = _blamed(s).where("tombstoned = 0").groupBy("seed").agg(F.min(F.struct("label", "id"))["id"].alias("weakest"))
    out = s.nodes.join(weak, s.nodes["id"] == weak["seed"], "left")
    return out.select("id", F.when(F.col("label") >= 2, "allow").otherwise("deny").alias("decision"), F.col("label").alias("floor"), F.when(F.col("label") < 2, F.col("weakest")).alias("culprit"))


@query("elevate_check", f"""{LABELS}, pf AS (SELECT l.child AS id, min(eff.label) AS floor FROM live l JOIN eff ON eff.id = l.parent GROUP BY l.child)
  SELECT n.id, CASE WHEN n.tombstoned = 1 THEN 'refused: tombstoned' WHEN n.label = 3 THEN 'refused: nothing to raise' WHEN coalesce(pf.floor, n.label) = 0 THEN 'needs force' ELSE 'raise' END AS verdict
  FROM {{nodes}} n LEFT JOIN pf ON pf.id = n.id""")
def _(s):
    """May a node be raised to endorsed? Only upwards; from an external floor only by force."""
    live = s.edges.join(s.nodes.where("tombstoned = 0").select(F.col("id").alias("parent")), "parent", "left_semi")
    floor = live.join(effective_labels(s), live["parent"] == F.col("id")).groupBy(F.col("child").alias("id")).agg(F.min("label").alias("floor"))
    verdict = F.when(F.col("tombstoned") == 1, "refused: tombstoned").when(F.col("label") == 3, "refused: nothing to raise").when(F.coalesce("floor", "label") == 0, "needs force").otherwise("raise")
    return s.nodes.join(floor, "id", "left").select("id", verdict.alias("verdict"))


shared("classify_check", "SELECT id, CASE WHEN archived = 1 AND conf_label > 1 THEN 'refused: archived' WHEN conf_label = 1 THEN 'unchanged' ELSE 'set' END AS verdict FROM {src}")

HEAL = f"""{LABELS}, effc AS (SELECT u.seed AS id, max(n.conf_label) AS conf FROM (WITH RECURSIVE u2 AS (SELECT id AS seed, id FROM {{nodes}} UNION SELECT a.seed, l.parent FROM u2 a JOIN live l ON l.child = a.id) SELECT * FROM u2) u
   JOIN {{nodes}} n ON n.id = u.id WHERE n.channel <> 'agent-derived' OR n.id NOT IN (SELECT child FROM live) GROUP BY u.seed)
 SELECT kind, count(*) AS n FROM (
  SELECT 'integrity mismatch' AS kind FROM {{nodes}} n JOIN eff ON eff.id = n.id WHERE n.tombstoned = 0 AND eff.label <> n.label
  UNION ALL SELECT 'confidentiality mismatch' FROM {{nodes}} n JOIN effc ON effc.id = n.id WHERE n.tombstoned = 0 AND effc.conf <> n.conf_label
  UNION ALL SELECT 'live child of a tombstoned parent' FROM (SELECT DISTINCT e.child FROM {{edges}} e JOIN {{nodes}} c ON c.id = e.child JOIN {{nodes}} p ON p.id = e.parent WHERE c.tombstoned = 0 AND p.tombstoned = 1) x
  UNION ALL SELECT 'redacted with content' FROM {{nodes}} WHERE redacted = 1 AND content <> ''
  UNION ALL SELECT 'dangling edge' FROM {{edges}} WHERE child NOT IN (SELECT id FROM {{nodes}}) OR parent NOT IN (SELECT id FROM {{nodes}})) v GROUP BY kind"""


def violations(s):
    """(kind, id) of the five consistency checks."""
    live = s.nodes.where("tombstoned = 0")
    kind = lambda df, name, col="id": df.select(F.lit(name).alias("kind"), F.col(col).alias("id"))
    eff = effective_labels(s).withColumnRenamed("label", "eff")
    dead = s.edges.join(live.select(F.col("id").alias("child")), "child", "left_semi").join(s.nodes.where("tombstoned = 1").select(F.col("id").alias("parent")), "parent", "left_semi").select("child").distinct()
    parts = [
        kind(live.join(eff, "id").where("eff <> label"), "integrity mismatch"), kind(live.join(effective_confs(s), "id").where("conf <> conf_label"), "confidentiality mismatch"),
        kind(dead, "live child of a tombstoned parent", "child"), kind(s.nodes.where("redacted = 1 and content <> ''"), "redacted with content"), kind(dangling(s.edges, s.nodes), "dangling edge", "child"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("heal_check", HEAL)
def _(s):
    return violations(s).groupBy("kind").agg(F.count("*").alias("n"))


# --- associative graph, versions -------------------------------------------------------------------------------------------

CONDUCTS = "tombstoned = 0 AND status <> 'quarantined'"
NEAR = f"""WITH RECURSIVE bi AS (SELECT a AS u, b AS v FROM {{rel}} UNION SELECT b, a FROM {{rel}}), ok AS (SELECT id, label, conf_label, archived FROM {{src}} WHERE {CONDUCTS}),
  h1 AS (SELECT b.u AS seed, b.v AS id, 1 AS hop, least(s.label, o.label) AS path_min FROM bi b JOIN {{src}} s ON s.id = b.u JOIN ok o ON o.id = b.v WHERE s.channel = 'endorsed'),
  h2 AS (SELECT h.seed, b.v AS id, 2 AS hop, least(h.path_min, o.label) AS path_min FROM h1 h JOIN bi b ON b.u = h.id JOIN ok o ON o.id = b.v),
  hood AS (SELECT seed, id, min(hop) AS hop, max(path_min) AS path_min FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) x WHERE seed <> id GROUP BY seed, id)"""


def _hood(s, seeds, hops=2):
    nodes = s.src.select("id", "label", F.expr(CONDUCTS).alias("conducts"))
    return graph.neighborhood(nodes, s.rel, seeds, hops)


@query("neighborhood", f"{NEAR} SELECT h.seed, h.id, h.hop, h.path_min FROM hood h JOIN ok o ON o.id = h.id WHERE o.archived = 0 AND o.conf_label <= 2 AND h.path_min >= 1")
def _(s):
    """Nodes above the clearance and archived ones conduct, but are not shown."""
    shown = s.src.where(f"{CONDUCTS} and archived = 0 and conf_label <= 2").select("id")
    return _hood(s, s.src.where("channel = 'endorsed'").select("id")).where("path_min >= 1").join(shown, "id", "left_semi").select("seed", "id", "hop", "path_min")


HASHES = "SELECT doc_id AS id, source AS ref, sha256(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS h FROM {documents}"
SUPERSEDES = f"""WITH firsts AS (SELECT min(id) AS id, ref, h FROM ({HASHES}) x GROUP BY ref, h),
  sup AS (SELECT prev AS old_id, id AS new_id FROM (SELECT id, lag(id) OVER (PARTITION BY ref ORDER BY id) AS prev FROM firsts) y WHERE prev IS NOT NULL)"""


def supersedes(s):
    """(old_id, new_id): a text replaces the newest one of the same source with another hash; copies were dropped before."""
    from pyspark.sql.window import Window

    from ..functions.text import content_hash

    first = s.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("ref"), content_hash(F.coalesce("text", F.lit(""))).alias("h")).groupBy("ref", "h").agg(F.min("id").alias("id"))
    return first.select(F.lag("id").over(Window.partitionBy("ref").orderBy("id")).alias("old_id"), F.col("id").alias("new_id")).where("old_id is not null")


@query("supersedes", f"{SUPERSEDES} SELECT old_id, new_id FROM sup")
def _(s):
    return supersedes(s)


HEADS = SUPERSEDES.replace("WITH", "WITH RECURSIVE", 1) + ", run AS (SELECT old_id AS id, new_id AS head FROM sup UNION SELECT r.id, x.new_id FROM run r JOIN sup x ON x.old_id = r.head)"


def fresh_heads(s):
    return graph.heads(materialise(supersedes(s), "sup").select(F.col("old_id").alias("id"), F.col("new_id").alias("next")))


@query("fresh_head", f"{HEADS} SELECT id, max(head) AS head FROM run GROUP BY id")
def _(s):
    return fresh_heads(s)


@query("version_chain", f"{HEADS}, top AS (SELECT id, max(head) AS head FROM run GROUP BY id) SELECT id, head AS lineage FROM top UNION SELECT head, head FROM top")
def _(s):
    """Every version with its lineage, named by the newest version."""
    heads = materialise(fresh_heads(s), "heads")
    return heads.select("id", F.col("head").alias("lineage")).union(heads.select("head", "head")).distinct()


SUBST = f"""{HEADS}, top AS (SELECT id, max(head) AS head FROM run GROUP BY id)
  SELECT DISTINCT CASE WHEN p.stale = 1 AND g.id IS NOT NULL THEN g.id ELSE p.id END AS id FROM (SELECT * FROM {{src}} WHERE {POOL}) p LEFT JOIN top t ON t.id = p.id
  LEFT JOIN (SELECT id FROM {{src}} WHERE {POOL} AND stale = 0) g ON g.id = t.head"""


@query("substitute_fresh", SUBST)
def _(s):
    pool = s.src.where(filters.untainted())
    fresh = pool.where("stale = 0").select(F.col("id").alias("fresh"))
    heads = fresh_heads(s).withColumnRenamed("id", "old")
    out = pool.join(heads, pool["id"] == heads["old"], "left").join(fresh, F.col("head") == fresh["fresh"], "left")
    return out.select(F.when((F.col("stale") == 1) & F.col("fresh").isNotNull(), F.col("fresh")).otherwise(F.col("id")).alias("id")).distinct()


@query("stale_annotations", f"{HEADS}, top AS (SELECT id, max(head) AS head FROM run GROUP BY id) SELECT n.id, t.head AS fresh_version FROM {{src}} n LEFT JOIN top t ON t.id = n.id WHERE n.stale = 1")
def _(s):
    return s.src.where("stale = 1").select("id").join(fresh_heads(s), "id", "left").select("id", F.col("head").alias("fresh_version"))


@query("freshen_preview", f"""{HEADS}, top AS (SELECT id, max(head) AS head FROM run GROUP BY id)
  SELECT e.child, e.parent AS old_parent, t.head AS new_parent FROM {{edges}} e JOIN {{src}} p ON p.id = e.parent JOIN top t ON t.id = e.parent JOIN {{src}} h ON h.id = t.head WHERE p.stale = 1 AND h.tombstoned = 0""")
def _(s):
    """Edges that would be rewired from a stale parent to its live newest version."""
    heads = fresh_heads(s).select(F.col("id").alias("parent"), F.col("head").alias("new_parent"))
    old = s.edges.join(s.src.where("stale = 1").select(F.col("id").alias("parent")), "parent", "left_semi")
    return old.join(heads, "parent").join(s.src.where("tombstoned = 0").select(F.col("id").alias("new_parent")), "new_parent", "left_semi").select("child", F.col("parent").alias("old_parent"), "new_parent")


@query("erase", f"""{HEADS}, top AS (SELECT id, max(head) AS head FROM run GROUP BY id), line AS (SELECT id, head FROM top UNION SELECT head, head FROM top),
  hit AS (SELECT DISTINCT l.head FROM line l JOIN {{src}} n ON n.id = l.id WHERE n.redacted = 1), gone AS (SELECT l.id FROM line l JOIN hit ON hit.head = l.head UNION SELECT e.child FROM gone g JOIN {{edges}} e ON e.parent = g.id) SELECT id FROM gone""")
def _(s):
    """Redaction of any version takes the whole lineage and all that was derived from it."""
    heads = materialise(fresh_heads(s), "heads")
    line = heads.select("id", "head").union(heads.select("head", "head")).distinct()
    hit = line.join(s.src.where("redacted = 1").select("id"), "id", "left_semi").select("head").distinct()
    return graph.reachable(s.edges, line.join(hit, "head", "left_semi").select("id"))


@query("explain_tree", """WITH RECURSIVE p AS (SELECT id AS seed, id, [id] AS path FROM {der} WHERE id % 10 = 3 UNION ALL SELECT p.seed, e.parent, list_append(p.path, e.parent) FROM p JOIN {edges} e ON e.child = p.id WHERE NOT list_contains(p.path, e.parent)),
  first_ AS (SELECT seed, id, min(path) AS path FROM p GROUP BY seed, id),
  shown AS (SELECT seed, id, path AS at_ FROM first_ WHERE seed = id UNION ALL SELECT f.seed, e.parent, list_append(f.path, e.parent) FROM first_ f JOIN {edges} e ON e.child = f.id)
  SELECT s.seed, row_number() OVER (PARTITION BY s.seed ORDER BY at_)::INT AS position, len(at_)::INT - 1 AS depth, s.id, at_ <> f.path AS elided FROM shown s JOIN first_ f ON f.seed = s.seed AND f.id = s.id""")
def _(s):
    """The ancestry of a stated set of nodes as it is printed, diamonds elided."""
    return graph.explain_tree(s.edges, s.der.where("id % 10 = 3").select("id"))


@query("explain_paths", """WITH RECURSIVE p AS (SELECT child AS seed, parent AS id, 1 AS depth FROM {edges} UNION SELECT p.seed, e.parent, p.depth + 1 FROM p JOIN {edges} e ON e.child = p.id WHERE p.depth < 40)
  SELECT seed, id, min(depth) AS depth FROM p GROUP BY seed, id""")
def _(s):
    """Each ancestor at its least depth, 40 at most as in the SQL: a diamond shows once."""
    return graph.distances(s.edges, None, "child", "parent", most=40)


@query("rel_components", """WITH RECURSIVE bi AS (SELECT a AS u, b AS v FROM {rel} UNION SELECT b, a FROM {rel}), r AS (SELECT u, v FROM bi UNION SELECT r.u, b.v FROM r JOIN bi b ON b.u = r.v)
  SELECT u AS id, least(u, min(v)) AS component FROM r GROUP BY u""")
def _(s):
    return connected_components(s.rel)
