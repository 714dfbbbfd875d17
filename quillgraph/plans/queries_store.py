"""Ingest, versions, claims, sessions, forgetting, federation, reporting and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import vectors as V
from ..operators import asof, digest, filters, lifecycle, scan, scoring, similarity
from ..operators.components import connected_components
from . import queries_graph as G
from . import queries_text as X
from .queries_graph import POOL, TAINT
from .views import Store

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def shared(name: str, sql: str) -> None:
    query(name, sql)(lambda s: s.sql(sql))


NORM = "sha256(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"

# --- ingest --------------------------------------------------------------------------------------------------------------


@query("ingest_label", "SELECT id, channel, CASE channel WHEN 'endorsed' THEN 3 WHEN 'user' THEN 2 WHEN 'agent-derived' THEN 1 ELSE 0 END AS label FROM {nodes}")
def _(s):
    return s.nodes.select("id", "channel", lifecycle.rank_of(F.col("channel")).alias("label"))


@query("ingest_guard", "SELECT id, CASE WHEN label > 2 THEN 'refused: above ceiling' WHEN source_ref IN ('src0', 'src19') THEN 'refused: reserved name' ELSE 'accepted' END AS verdict FROM {src}")
def _(s):
    return s.src.select("id", lifecycle.guard(F.col("label"), F.col("source_ref"), ceiling=2, reserved=("src0", "src19")).alias("verdict"))


@query("effective_channel", "SELECT id, least(2, CASE WHEN id % 3 = 0 THEN label ELSE 2 END) AS rank FROM {src}")
def _(s):
    """A declared channel may lower the default one, never raise it."""
    declared = F.when(F.col("id") % 3 == 0, F.col("label"))
    return s.src.select("id", F.least(F.lit(2), F.coalesce(declared, F.lit(2))).alias("rank"))


@query("ingest_dedup", f"SELECT h, channel, min(id) AS id, count(*) AS n FROM (SELECT id, channel, {NORM.format(c='content')} AS h FROM {{src}} WHERE {POOL}) x GROUP BY h, channel")
def _(s):
    pool = s.src.where(filters.untainted())
    return pool.groupBy(T.content_hash(F.col("content")).alias("h"), "channel").agg(F.min("id").alias("id"), F.count("*").alias("n"))


@query("ingest_pages", f"""SELECT page_id, 'external' AS channel, 0 AS label, {NORM.format(c="regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g')")} AS h FROM {{pages}}""")
def _(s):
    plain = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(?:script|style)>", " "), "<[^>]*>", " ")
    return s.pages.select("page_id", F.lit("external").alias("channel"), F.lit(0).alias("label"), T.content_hash(plain).alias("h"))


shared("chat_channels", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'agent-derived' END AS channel, length(text) AS n FROM {conversations}")


FULL = """SELECT coalesce(l.id, f.id) AS id, CASE WHEN l.id IS NULL THEN 'created' WHEN f.id IS NULL THEN 'tombstoned' WHEN l.h <> f.h THEN 'updated' ELSE 'skipped' END AS action
  FROM (SELECT id, CASE WHEN id % 3 = 0 THEN 'old' ELSE {norm} END AS h FROM {{files}} WHERE id % 5 <> 0) l FULL OUTER JOIN (SELECT id, {norm} AS h FROM {{files}} WHERE id % 7 <> 2) f ON f.id = l.id""".format(norm=NORM.format(c="content"))


def reconcile(s: Store):
    """A stored snapshot against the files that are there: one full outer join, one action for each path."""
    h = T.content_hash(F.col("content"))
    stored = s.files.where("id % 5 <> 0").select("id", F.when(F.col("id") % 3 == 0, "old").otherwise(h).alias("h")).alias("l")
    there = s.files.where("id % 7 <> 2").select("id", h.alias("h")).alias("f")
    action = F.when(F.col("l.id").isNull(), "created").when(F.col("f.id").isNull(), "tombstoned").when(F.col("l.h") != F.col("f.h"), "updated").otherwise("skipped")
    return stored.join(there, F.col("l.id") == F.col("f.id"), "full_outer").select(F.coalesce("l.id", "f.id").alias("id"), action.alias("action"))


query("reconcile_sync", FULL)(reconcile)
query("reconcile_plan", f"SELECT action, count(*) AS n FROM ({FULL}) x GROUP BY action")(lambda s: reconcile(s).groupBy("action").agg(F.count("*").alias("n")))
shared("reconcile_gone", "SELECT l.id FROM {files} l LEFT JOIN (SELECT id FROM {files} WHERE id % 7 <> 2) f ON f.id = l.id WHERE f.id IS NULL")


@query("dup_resolve", f"""WITH h AS (SELECT *, {NORM.format(c='content')} AS h FROM {{files}}), g AS (SELECT stem, count(DISTINCT h) AS k FROM h GROUP BY stem)
  SELECT stem, id FROM (SELECT h.stem, h.id, row_number() OVER (PARTITION BY h.stem ORDER BY CASE WHEN g.k = 1 THEN h.depth ELSE h.mtime END DESC, h.id) AS r FROM h JOIN g ON g.stem = h.stem) x WHERE r = 1""")
def _(s):
    """Of files with one name the deepest if all are equal, else the newest."""
    h = s.files.select("stem", "id", "depth", "mtime", T.content_hash(F.col("content")).alias("h"))
    pick = lambda c: F.max(F.struct(F.col(c).cast("long").alias("o"), (-F.col("id")).alias("i")))["i"]
    return h.groupBy("stem").agg(F.countDistinct("h").alias("k"), pick("depth").alias("deep"), pick("mtime").alias("new")).select("stem", (-F.when(F.col("k") == 1, F.col("deep")).otherwise(F.col("new"))).alias("id"))


@query("resolve_links", "SELECT f.id, f.stem, t.id AS target FROM {files} f LEFT JOIN (SELECT stem, min(id) AS id FROM {files} GROUP BY stem HAVING count(*) = 1) t ON t.stem = f.stem")
def _(s):
    """A bare name resolves only where it is unique."""
    unique = s.files.groupBy("stem").agg(F.count("*").alias("n"), F.min("id").alias("target")).where("n = 1").select("stem", "target")
    return s.files.select("id", "stem").join(unique, "stem", "left").select("id", "stem", "target")


@query("note_export", "SELECT e.child AS id, '# mem ' || e.child || chr(10) || string_agg('- [[mem-' || e.parent || ']]', chr(10) ORDER BY e.parent) AS note FROM {edges} e GROUP BY e.child")
def _(s):
    parents = s.edges.groupBy("child").agg(F.array_sort(F.collect_list("parent")).alias("p"))
    return parents.select(F.col("child").alias("id"), F.concat(F.lit("# mem "), F.col("child").cast("string"), F.lit("\n"), F.array_join(F.transform("p", lambda x: F.concat(F.lit("- [[mem-"), x.cast("string"), F.lit("]]"))), "\n")).alias("note"))


# --- facts, versions -------------------------------------------------------------------------------------------------------

GRID = ("1993-06-30", "1995-01-01", "1998-01-01")
_GRID_SQL = " UNION ALL ".join(f"SELECT TIMESTAMP '{d} 00:00:00' AS as_of" for d in GRID)


@query("fact_asof", f"""SELECT stem, as_of, coalesce(arg_max(value, (created_at, id)) FILTER (WHERE created_at <= as_of), arg_min(value, (created_at, id))) AS value FROM {{facts}} CROSS JOIN ({_GRID_SQL}) g GROUP BY stem, as_of""")
def _(s):
    """The last version not after a date, else the first one: one pass of combinable maxima for the whole grid of dates."""
    order = F.struct("created_at", "id")
    rows = s.facts.withColumn("as_of", F.explode(F.array(*(F.to_timestamp(F.lit(d)) for d in GRID))))
    known = F.when(F.col("created_at") <= F.col("as_of"), order)
    return rows.groupBy("stem", "as_of").agg(F.coalesce(F.max_by("value", known), F.min_by("value", order)).alias("value"))


shared("fact_versions", "SELECT stem, id, lag(id) OVER (PARTITION BY stem ORDER BY created_at, id) AS prev, lead(id) OVER (PARTITION BY stem ORDER BY created_at, id) AS next FROM {facts}")


@query("fact_refs", "SELECT d.id, 'value=' || CAST(CAST(floor(f.value) AS BIGINT) AS VARCHAR) AS resolved FROM (SELECT id, id % 1500 + 1 AS stem FROM {src}) d JOIN (SELECT stem, arg_max(value, (created_at, id)) AS value FROM {facts} GROUP BY stem) f ON f.stem = d.stem")
def _(s):
    latest = s.facts.groupBy("stem").agg(F.max_by("value", F.struct("created_at", "id")).alias("value"))
    refs = s.src.select("id", F.concat(F.lit("value={{fact:"), (F.col("id") % 1500 + 1).cast("string"), F.lit("}}")).alias("t"))
    refs = refs.withColumn("stem", F.regexp_extract("t", r"\{\{fact:(\d+)\}\}", 1).cast("long")).join(latest, "stem")
    return refs.select("id", F.expr("replace(t, concat('{{fact:', stem, '}}'), cast(cast(floor(value) as bigint) as string))").alias("resolved"))


_SHOWN = "CASE WHEN value IS NOT NULL THEN value || CASE WHEN unit <> '' THEN ' ' || unit ELSE '' END END"


@query("fact_refs_asof", f"""WITH v AS MATERIALIZED (SELECT *, {_SHOWN} AS shown FROM {{versions}}), one AS (SELECT stem, created_at, arg_max(nid, nid) AS nid, arg_max(coalesce(shown, chr(0)), nid) AS shown FROM v GROUP BY stem, created_at),
  live AS (SELECT stem, min(nid) AS nid, arg_min(coalesce(shown, chr(0)), nid) AS shown FROM v WHERE tombstoned = 0 GROUP BY stem),
  ends AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY stem ORDER BY created_at DESC, nid DESC) = 1), firsts AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY stem ORDER BY created_at, nid) = 1),
  refs AS (SELECT id, as_of, unnest(['fact_' || (id % 150 + 1), 'fact_' || (id % 97 * 3), 'fact_none']) AS stem, generate_subscripts([1, 2, 3], 1) AS k FROM {{reftexts}}),
  met AS (SELECT refs.id, refs.k, refs.stem, refs.as_of, CASE WHEN refs.as_of IS NOT NULL THEN coalesce(one.nid, firsts.nid) END AS nid, CASE WHEN one.nid IS NULL THEN firsts.shown ELSE nullif(one.shown, chr(0)) END AS shown
    FROM refs ASOF LEFT JOIN one ON refs.stem = one.stem AND refs.as_of >= one.created_at LEFT JOIN firsts ON firsts.stem = refs.stem),
  put AS (SELECT met.id, met.k, coalesce(CASE WHEN live.nid IS NOT NULL THEN nullif(live.shown, chr(0)) || CASE WHEN met.nid <> live.nid AND met.shown <> live.shown THEN ' (was ' || met.shown || ' when written, ' || strftime(met.as_of, '%Y-%m-%d') || ')' ELSE '' END
      ELSE ends.shown || ' (last known — fact retired' || CASE WHEN ends.tombstoned_at IS NOT NULL THEN ' ' || strftime(ends.tombstoned_at, '%Y-%m-%d') ELSE '' END || CASE WHEN trim(ends.reason) NOT IN ('', 'source file removed (bridge reconcile)') THEN ': ' || trim(ends.reason) ELSE '' END || ')' END, '[[' || met.stem || ']]') AS value
    FROM met LEFT JOIN live ON live.stem = met.stem LEFT JOIN ends ON ends.stem = met.stem)
  SELECT a.id, 'From ' || a.value || ' to ' || b.value || ', ' || c.value || ', [[note]] and ' || a.value AS text FROM put a JOIN put b ON a.id = b.id AND b.k = 2 JOIN put c ON a.id = c.id AND c.k = 3 WHERE a.k = 1""")
def _(s):
    """Several references in a text, each as it stood when the text was written."""
    return asof.resolve_references(s.reftexts, s.versions)


@query("asof_sales", """WITH c AS (SELECT client_id, valid_at, arg_max(change_id, (coalesce(seq, -1), change_id)) AS change_id FROM {client_changes} WHERE client_id IS NOT NULL AND valid_at IS NOT NULL GROUP BY 1, 2)
  SELECT s.sale_id, c.change_id, c.valid_at FROM {sales} s ASOF LEFT JOIN c ON s.client_id = c.client_id AND s.sold_at >= c.valid_at""")
def _(s):
    """Every sale with the last change of its client that is not after it."""
    found = asof.asof_join(s.sales.select("sale_id", "client_id", "sold_at"), s.client_changes.select("change_id", "client_id", "valid_at", "seq"), "client_id", "sold_at", "valid_at", ("seq", "change_id"))
    return found.select("sale_id", "fact.change_id", "fact.valid_at")


@query("latest_per_key", "SELECT stem, arg_max(id, (created_at, id)) AS id FROM {facts} GROUP BY stem")
def _(s):
    return s.facts.groupBy("stem").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))


# --- claims ----------------------------------------------------------------------------------------------------------------

shared("live_root_count", "SELECT c.part, c.flag, count(DISTINCT c.root) AS roots FROM {claims} c JOIN {roots} r ON r.root = c.root GROUP BY c.part, c.flag")
shared("corroborate", "SELECT c.part, c.flag, 1 AS label FROM {claims} c JOIN {roots} r ON r.root = c.root WHERE c.part % 10 <> 0 GROUP BY c.part, c.flag HAVING count(DISTINCT c.root) >= 7")
shared("claims_list", """SELECT c.part, c.flag, count(DISTINCT c.node) AS assertions, count(DISTINCT r.root) AS roots, max(CASE WHEN c.part % 10 = 0 THEN c.part END) AS lift
  FROM {claims} c LEFT JOIN {roots} r ON r.root = c.root GROUP BY c.part, c.flag""")
shared("assert_claim", "SELECT c.part, c.flag, c.node, min(c.root) AS root FROM {claims} c JOIN {roots} r ON r.root = c.root GROUP BY c.part, c.flag, c.node")


@query("novel_recombination", "WITH p AS (SELECT child, string_agg(CAST(parent AS VARCHAR), ',' ORDER BY parent) AS k FROM {edges} GROUP BY child) SELECT child, count(*) OVER (PARTITION BY k) = 1 AS novel FROM p")
def _(s):
    """Is a node the only one with its set of parents?"""
    sets = s.edges.groupBy("child").agg(F.array_sort(F.collect_set("parent")).alias("k"))
    used = sets.groupBy("k").agg(F.count("*").alias("n"))
    return sets.join(used, "k").select("child", (F.col("n") == 1).alias("novel"))


# --- sessions and policy ---------------------------------------------------------------------------------------------------

RULES = (("purch*", 3), ("log*", 1), ("*up", 2), ("view", 0), ("cl?ck", 1))
_GLOB = "CASE WHEN regexp_matches(tool, '^purch.*$') THEN 3 WHEN regexp_matches(tool, '^log.*$') THEN 1 WHEN regexp_matches(tool, '^.*up$') THEN 2 WHEN tool = 'view' THEN 0 WHEN regexp_matches(tool, '^cl.ck$') THEN 1 ELSE 3 END"
FLOOR = """w AS (SELECT *, least(2, coalesce(min(taint) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2)) AS floor,
  least(2, coalesce(min(taint) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 2)) AS before FROM {sessions})"""


@query("session_floor", f"WITH {FLOOR} SELECT session_id, event_id, before AS from_floor, floor AS to_floor FROM w WHERE floor < before")
def _(s):
    """The floor's drops: it starts at 2 and never rises."""
    return lifecycle.floors(s.sessions).where("floor < before").select("session_id", "event_id", F.col("before").alias("from_floor"), F.col("floor").alias("to_floor"))


@query("session_state", "SELECT session_id, least(2, coalesce(min(taint), 2)) AS floor FROM {sessions} GROUP BY session_id")
def _(s):
    return s.sessions.groupBy("session_id").agg(F.least(F.lit(2), F.coalesce(F.min("taint"), F.lit(2))).alias("floor"))


@query("policy_match", f"SELECT tool, {_GLOB} AS required, count(*) AS n FROM {{sessions}} GROUP BY tool")
def _(s):
    """The first matching rule; without one the highest floor is required."""
    tools = s.sessions.groupBy("tool").agg(F.count("*").alias("n"))
    return tools.select("tool", lifecycle.required_floor(F.col("tool"), RULES).alias("required"), "n")


@query("capability_log", f"WITH {FLOOR} SELECT tool, CASE WHEN before >= {_GLOB} THEN 'allow' ELSE 'deny' END AS decision, count(*) AS n FROM w GROUP BY 1, 2")
def _(s):
    decision = F.when(F.col("before") >= lifecycle.required_floor(F.col("tool"), RULES), "allow").otherwise("deny")
    return lifecycle.floors(s.sessions).groupBy("tool", decision.alias("decision")).agg(F.count("*").alias("n"))


_SCHEMA = """SELECT event_type AS tool, ts, event_id, CASE event_id % 3 WHEN 0 THEN concat('{{"name": "', event_type, '", "in": {{"b": [1, {{"y": 2, "x": 1}}], "a": ', CAST(user_id % 2 AS STRING), '}}}}')
  WHEN 1 THEN concat('{{"in":{{"a":', CAST(user_id % 2 AS STRING), ',"b":[1,{{"x":1,"y":2}}]}},"name":"', event_type, '"}}') ELSE concat('{{"in": {{"b": [1, {{"x": 1, "y": 2}}], "a": ', CAST(user_id % 2 AS STRING), CASE WHEN event_id % 7 = 0 THEN '.5' ELSE '' END, '}}, "name": "', event_type, '"}}') END AS schema_ FROM {events}"""


@query("schema_pins", """WITH h AS (SELECT event_type AS tool, ts, event_id, sha256('{"in":{"a":' || (user_id % 2) || CASE WHEN event_id % 3 = 2 AND event_id % 7 = 0 THEN '.5' ELSE '' END || ',"b":[1,{"x":1,"y":2}]},"name":"' || event_type || '"}') AS h FROM {events}),
  f AS (SELECT tool, h, first_value(h) OVER (PARTITION BY tool ORDER BY ts, event_id) AS pin FROM h) SELECT tool, min(pin) AS pin, count(*) AS n, sum(CASE WHEN h <> pin THEN 1 ELSE 0 END) AS changed FROM f GROUP BY tool""")
def _(s):
    """Pins of canonical schemas: neither the order of keys nor spacing changes a pin, another value or type does."""
    seen = s.sql(_SCHEMA).select("tool", F.sha2(T.canonical_json(F.col("schema_")), 256).alias("h"), "ts", "event_id")
    pins = seen.groupBy("tool").agg(F.min_by("h", F.struct("ts", "event_id")).alias("pin"))
    return seen.join(pins, "tool").groupBy("tool", "pin").agg(F.count("*").alias("n"), F.sum(F.when(F.col("h") != F.col("pin"), 1).otherwise(0)).alias("changed"))


@query("hook_sweep", """WITH l AS (SELECT value / 100 AS score FROM {clicks}), f AS (SELECT k, k / 10.0::DOUBLE AS floor FROM range(0, 11) t(k)), n AS (SELECT count(*) AS n FROM l)
  SELECT floor, (SELECT count(*) FROM l WHERE score >= floor AND NOT isnan(score)) AS hits, round((SELECT count(*) FROM l WHERE score >= floor AND NOT isnan(score)) / n.n::DOUBLE, 3) AS would_inject_rate,
    CASE WHEN k < 10 THEN format('{{:.1f}}-{{:.1f}}', k / 10.0::DOUBLE, (k + 1) / 10.0::DOUBLE) END AS bin,
    CASE WHEN k < 10 THEN (SELECT count(*) FROM l WHERE NOT isnan(score) AND least(9, greatest(0, trunc(score * 10))) = k) END AS bin_n FROM f CROSS JOIN n""".replace("{{", "{").replace("}}", "}"))
def _(s):
    """The rate that each of eleven floors would give, and the histogram of the scores, in one pass."""
    return scoring.threshold_sweep(s.clicks.select((F.col("value") / 100).alias("score")))


@query("tool_pins", "SELECT tool, count(*) AS n, sum(CASE WHEN h <> first_h THEN 1 ELSE 0 END) AS changed FROM (SELECT event_type AS tool, sha256(props) AS h, first_value(sha256(props)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS first_h FROM {events}) x GROUP BY tool")
def _(s):
    """The schema first seen is pinned; later ones that differ are reported."""
    seen = s.events.select(F.col("event_type").alias("tool"), F.sha2("props", 256).alias("h"), "ts", "event_id")
    pins = seen.groupBy("tool").agg(F.min_by("h", F.struct("ts", "event_id")).alias("first_h"))
    return seen.join(pins, "tool").groupBy("tool").agg(F.count("*").alias("n"), F.sum(F.when(F.col("h") != F.col("first_h"), 1).otherwise(0)).alias("changed"))


shared("recent_log", "SELECT id, query FROM {logq} ORDER BY ts DESC, id DESC LIMIT 20")
shared("top_queries", "SELECT query, count(*) AS n, max(ts) AS last FROM {logq} GROUP BY query ORDER BY n DESC, last DESC, query LIMIT 10")
shared("query_stats", "SELECT count(*) AS total, count(DISTINCT query) AS distinct_queries FROM {logq}")

# --- forgetting --------------------------------------------------------------------------------------------------------------

_E = lambda c: f"epoch(date_trunc('second', {c}))"
FORGET = f"""WITH RECURSIVE ev AS (SELECT user_id AS stem, least({_E('ts')}, {_E("TIMESTAMP '2024-02-05'")}) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {{events}}),
  f AS (SELECT DISTINCT stem, 0::BIGINT AS n, 1.0::DOUBLE AS rs, 0.0::DOUBLE AS ss, {_E("TIMESTAMP '2024-01-01'")} AS t FROM ev
    UNION ALL SELECT f.stem, ev.n, least(1.0, d.rs + 0.15::DOUBLE * (1 + ln(1 + d.ss))), d.ss, ev.t FROM f JOIN ev ON ev.stem = f.stem AND ev.n = f.n + 1,
      LATERAL (SELECT f.rs * CASE WHEN ev.t > f.t THEN pow(0.5::DOUBLE, (ev.t - f.t) / 604800.0::DOUBLE / (1 + f.ss)) ELSE 1 END AS r) a, LATERAL (SELECT a.r AS rs, least(3.0::DOUBLE, f.ss + 0.1::DOUBLE * (1 - a.r)) AS ss) d),
  l AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY n DESC) AS k FROM f),
  x AS (SELECT stem, n AS cnt, round(rs * pow(0.5::DOUBLE, ({_E("TIMESTAMP '2024-02-05'")} - t) / 604800.0::DOUBLE / (1 + ss)), 4) AS rs, round(ss, 4) AS ss FROM l WHERE k = 1)"""


@query("forget_rs_ss", f"{FORGET} SELECT stem, cnt, round(rs, 3) AS rs, round(ss, 3) AS ss, CASE WHEN stem % 17 = 0 THEN 'hot' WHEN rs < 0.2 THEN 'cold' ELSE 'hot' END AS tier FROM x")
def _(s):
    return lifecycle.forget(s.events.select(F.col("user_id").alias("stem"), "ts", "event_id")).select("stem", "cnt", F.round("rs", 3).alias("rs"), F.round("ss", 3).alias("ss"), F.when(F.col("stem") % 17 == 0, "hot").when(F.col("rs") < 0.2, "cold").otherwise("hot").alias("tier"))


shared("pin_violations", "SELECT id, source_ref FROM {src} WHERE channel = 'endorsed' AND stale = 1 AND tombstoned = 0")

NOTES = "SELECT id, CASE id % 4 WHEN 0 THEN content || CASE id % 5 WHEN 0 THEN ' not yet deployed' WHEN 1 THEN ' is not wired' WHEN 2 THEN ' Unpushed work' WHEN 3 THEN ' not fully rebuilt now' ELSE ' not quite yet done' END WHEN 1 THEN content || ' due: 2024-0' || (id % 9 + 1) || '-15' ELSE content END AS content, DATE '2023-12-01' + CAST(id % 90 AS INTEGER) AS seen FROM {src}"


@query("verify_stale", f"""WITH n AS ({NOTES}), d AS (SELECT *, try_cast(nullif(regexp_extract(content, '(?i)\\b(?:due|deadline)\\b[:\\s]+([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), '') AS DATE) AS due FROM n)
  SELECT id, CASE WHEN due <= DATE '2024-02-20' THEN 'overdue: ' || due || ' passed' ELSE 'unverified since ' || strftime(seen, '%Y-%m') END AS reason FROM d
  WHERE due <= DATE '2024-02-20' OR (regexp_matches(content, '(?i)\\bnot\\s+(?:\\w+\\s+)?(?:{lifecycle.UNFINISHED})\\b|\\bun(?:{lifecycle.UNDONE})\\b') AND date_diff('day', seen, DATE '2024-02-20') > 45)""".replace("{{4}}", "{4}").replace("{{2}}", "{2}"))
def _(s):
    content = F.when(F.col("id") % 4 == 0, F.concat("content", F.element_at(F.array(*map(F.lit, (" not yet deployed", " is not wired", " Unpushed work", " not fully rebuilt now", " not quite yet done"))), (F.col("id") % 5 + 1).cast("int")))).when(F.col("id") % 4 == 1, F.concat("content", F.lit(" due: 2024-0"), (F.col("id") % 9 + 1).cast("string"), F.lit("-15"))).otherwise(F.col("content"))
    notes = s.src.select("id", content.alias("content"), F.date_add(F.lit("2023-12-01").cast("date"), (F.col("id") % 90).cast("int")).alias("seen"))
    return lifecycle.verify_stale(notes, "2024-02-20", 45)


# --- federation --------------------------------------------------------------------------------------------------------------

MERGE = """SELECT coalesce(l.id, i.id) AS id,
  CASE WHEN l.id IS NULL AND i.trusted = 1 THEN 'inserted' WHEN l.id IS NULL THEN 'inserted, clamped' WHEN i.id IS NULL THEN 'kept' WHEN i.trusted = 1 AND (i.tombstoned > l.tombstoned OR i.redacted > l.redacted) THEN 'updated' ELSE 'unchanged' END AS action,
  CASE WHEN l.id IS NULL AND i.trusted = 0 THEN 0 ELSE coalesce(l.label, i.label) END AS label,
  CASE WHEN l.id IS NULL THEN i.tombstoned WHEN i.trusted = 1 THEN greatest(l.tombstoned, i.tombstoned) ELSE l.tombstoned END AS tombstoned,
  CASE WHEN l.id IS NULL THEN i.redacted WHEN i.trusted = 1 THEN greatest(l.redacted, i.redacted) ELSE l.redacted END AS redacted
FROM (SELECT * FROM {src} WHERE id % 5 <> 0) l
FULL OUTER JOIN (SELECT id, label, CASE WHEN id % 7 = 2 THEN 1 ELSE 0 END AS tombstoned, CASE WHEN id % 21 = 6 THEN 1 ELSE 0 END AS redacted, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS trusted FROM {src} WHERE id % 3 = 0) i ON i.id = l.id"""


@query("federation_merge", MERGE)
def _(s):
    """Monotonic merge: flags only rise, only the owner's word counts, the unknown is clamped."""
    incoming = s.src.where("id % 3 = 0").select("id", "label", F.when(F.col("id") % 7 == 2, 1).otherwise(0).alias("tombstoned"), F.when(F.col("id") % 21 == 6, 1).otherwise(0).alias("redacted"), (F.col("id") % 2 == 0).alias("trusted"))
    return lifecycle.merge(s.src.where("id % 5 <> 0"), incoming)


query("federation_stats", f"SELECT action, count(*) AS n FROM ({MERGE}) m GROUP BY action")(lambda s: QUERIES["federation_merge"](s).groupBy("action").agg(F.count("*").alias("n")))


shared("conf_coerce", "SELECT id, least(3, greatest(0, coalesce(TRY_CAST(raw AS INTEGER), 0))) AS conf FROM (SELECT id, CASE WHEN id % 5 = 0 THEN 'x' ELSE CAST(id % 9 - 2 AS STRING) END AS raw FROM {src}) r")

# --- export, consolidation ---------------------------------------------------------------------------------------------------

TRAIN = f"""{TAINT}, ok AS (SELECT * FROM {{der}} WHERE {POOL} AND label >= 1 AND id NOT IN (SELECT id FROM ext))"""


def clean_derived(s: Store):
    return s.der.where(filters.untainted() & (F.col("label") >= 1)).join(G.tainted_by(s, "external"), "id", "left_anti")


@query("export_training", f"{TRAIN} SELECT o.id, o.content AS response, string_agg(CAST(e.parent AS VARCHAR), ',' ORDER BY e.parent) AS parents FROM ok o JOIN {{edges}} e ON e.child = o.id GROUP BY o.id, o.content")
def _(s):
    parents = s.edges.groupBy("child").agg(F.array_join(F.transform(F.array_sort(F.collect_list("parent")), lambda x: x.cast("string")), ",").alias("parents"))
    return clean_derived(s).join(parents, F.col("id") == F.col("child")).select("id", F.col("content").alias("response"), "parents")


@query("export_reflex", f"{TRAIN} SELECT id, k, CASE k WHEN 0 THEN 'ask' WHEN 1 THEN 'context' ELSE 'refuse' END AS template, length(content) AS n FROM ok CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) t")
def _(s):
    templates = F.posexplode(F.array(F.lit("ask"), F.lit("context"), F.lit("refuse")))
    return clean_derived(s).select("id", templates.alias("k", "template"), F.length("content").alias("n"))


@query("compact_plan", f"""WITH RECURSIVE {X.POOLED}, l AS (SELECT a AS u, b AS v FROM pq WHERE jaccard >= 0.5 UNION SELECT b, a FROM pq WHERE jaccard >= 0.5), r AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.v),
  g AS (SELECT u AS id, least(u, min(v)) AS grp FROM r GROUP BY u) SELECT g.grp, count(*) AS n, min(s.label) AS floor, max(s.conf_label) AS conf, CASE WHEN min(s.label) = 0 THEN 'quarantine' ELSE 'archive' END AS action FROM g JOIN {{src}} s ON s.id = g.id GROUP BY g.grp""")
def _(s):
    """Groups of similar nodes: what their summary would inherit, and whether the gate would hold it."""
    groups = connected_components(similarity.jaccard_links(X.pool_sets(s), 0.5))
    plan = groups.join(s.src, "id").groupBy(F.col("component").alias("grp")).agg(F.count("*").alias("n"), F.min("label").alias("floor"), F.max("conf_label").alias("conf"))
    return plan.withColumn("action", F.when(F.col("floor") == 0, "quarantine").otherwise("archive"))


@query("prefetch", f"""WITH {X.QUERY_TERMS}, {X.BM25}, {X.PIDS}, asked AS (SELECT b.item_id AS qid, count(*) AS n FROM {{benchmark}} b JOIN {{events}} e ON e.user_id % 40 = b.item_id GROUP BY b.item_id ORDER BY n DESC, qid LIMIT 3)
  SELECT qid, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM bm WHERE qid IN (SELECT qid FROM asked) AND id IN (SELECT id FROM pool)) x WHERE r <= 8""")
def _(s):
    """Answers kept warm for the three most asked queries."""
    from ..operators import retrieval

    asked = s.benchmark.select(F.col("item_id").alias("qid")).join(s.events.select((F.col("user_id") % 40).alias("qid")), "qid").groupBy("qid").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "qid").limit(3)
    q = X.queries_of(s).join(asked, "qid", "left_semi")
    return retrieval.ranked(retrieval.bm25(X.lexical(s, q), q).join(X.pool_of(s), "id", "left_semi"), 8).select("qid", "id", "score")


@query("tombstone_plan", "SELECT stem, id, CASE WHEN stem % 10 = 0 THEN 'refused: pinned' ELSE 'tombstone' END AS action FROM (SELECT stem, arg_max(id, (created_at, id)) AS id FROM {facts} GROUP BY stem) x")
def _(s):
    return QUERIES["latest_per_key"](s).select("stem", "id", F.when(F.col("stem") % 10 == 0, "refused: pinned").otherwise("tombstone").alias("action"))


@query("heal_rebuild", f"{G.LABELS} SELECT CASE WHEN eff.label < n.label THEN 'lowered' ELSE 'raised' END AS change, count(*) AS n FROM {{nodes}} n JOIN eff ON eff.id = n.id WHERE eff.label <> n.label GROUP BY 1")
def _(s):
    changed = G.QUERIES["recompute_changes"](s)
    return changed.groupBy(F.when(F.col("effective") < F.col("stored"), "lowered").otherwise("raised").alias("change")).agg(F.count("*").alias("n"))


# --- reporting ---------------------------------------------------------------------------------------------------------------

shared("telemetry_tiers", "SELECT channel, count(*) AS n, sum(stale) AS stale, sum(tombstoned) AS dead, sum(archived) AS archived FROM {nodes} GROUP BY channel")
shared("telemetry_histogram", "SELECT CAST(least(9, floor(w * 10)) AS INTEGER) AS bucket, count(*) AS n FROM (SELECT id % 101 / 100.0 AS w FROM {src}) x GROUP BY 1")
shared("telemetry_growth", "SELECT day, n, sum(n) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS total FROM (SELECT CAST(CAST(ts AS DATE) AS STRING) AS day, count(*) AS n FROM {events} GROUP BY 1) d")


@query("hook_stats", """WITH v AS (SELECT event_type AS mode, round(value, 2) AS ms, row_number() OVER (PARTITION BY event_type ORDER BY round(value, 2)) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM {events} WHERE value IS NOT NULL)
  SELECT mode, min(n) AS n, max(CASE WHEN i = n // 2 THEN ms END) AS p50, max(CASE WHEN i = CAST(floor(n * 0.95) AS BIGINT) THEN ms END) AS p95 FROM v GROUP BY mode""")
def _(s):
    """Percentiles by index: element n div 2 and int(n * 0.95) of the sorted values. Values of two digits are counted first."""
    counts = s.events.where("value is not null").groupBy(F.col("event_type").alias("mode"), F.round("value", 2).alias("ms")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("mode")
    upto = counts.withColumn("upto", F.sum("c").over(w.orderBy("ms"))).withColumn("n", F.sum("c").over(w))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("ms")))
    return upto.groupBy("mode").agg(F.min("n").alias("n"), at(F.floor(F.col("n") / 2)).alias("p50"), at(F.floor(F.col("n") * 0.95)).alias("p95"))


@query("section_shed", "SELECT id, source_ref, total <= 600 AS kept FROM (SELECT id, source_ref, sum(least(length(content), 70) + 1) OVER (PARTITION BY source_ref ORDER BY id DESC ROWS UNBOUNDED PRECEDING) AS total FROM {src} WHERE tombstoned = 0) x")
def _(s):
    """Entries of a section, newest first, while they fit its budget."""
    rows = s.src.where("tombstoned = 0").select("id", "source_ref", (-F.col("id")).alias("newest"), (F.least(F.length("content"), F.lit(70)) + 1).alias("bytes"))
    return lifecycle.shed(rows, "source_ref", ("newest",), 600).select("id", "source_ref", "kept")


ENTRIES = """SELECT id, CASE WHEN id % 29 <> 0 THEN source_ref END AS section, CASE WHEN id % 37 = 0 THEN 'literal' ELSE 'file' END AS kind, id % 31 = 0 AS cluster, id % 7 = 0 AS own_line,
  channel = 'endorsed' AND id % 5 = 0 AS pinned, id % 11 = 1 AS live_state, CASE WHEN id % 23 <> 0 THEN CAST(id * 37 % 1009 AS DOUBLE) / 10 END AS rs, CASE WHEN id % 19 <> 0 THEN id * 53 % 701 END AS born,
  concat('- [note](', CAST(id AS STRING), '.md) ', substr(replace(content, chr(10), ' '), 1, 70)) AS line FROM {src} WHERE tombstoned = 0"""
_BUDGET, _LINES, _CAP = 16384, 180, 900
#: Running sums over the reverse of the orders in which entries go; headings go with their section's last entry.
DIGEST = f"""WITH e AS MATERIALIZED (SELECT *, strlen(line) + 1 AS b, kind = 'file' AND NOT cluster AS free, strlen('## ' || section) + 2 AS head FROM ({ENTRIES}) x),
  s1 AS MATERIALIZED (SELECT *, free AND head + sum(b) OVER (PARTITION BY section ORDER BY free, own_line DESC, born NULLS FIRST, coalesce(rs, 0) DESC, id DESC ROWS UNBOUNDED PRECEDING) > {_CAP} AS shed FROM e WHERE section IS NOT NULL),
  s2 AS MATERIALIZED (SELECT *, kind <> 'file' OR pinned AS exempt FROM s1 WHERE NOT shed),
  held AS (SELECT section, bool_or(exempt) AS held FROM s2 GROUP BY section),
  fixed AS (SELECT 9 + 1 + coalesce(sum(CASE WHEN exempt THEN b ELSE 0 END), 0) + (SELECT coalesce(sum(strlen('## ' || section) + 2), 0) FROM held WHERE held) AS b, 1 + count_if(exempt) + 2 * (SELECT count(*) FROM held WHERE held) AS n FROM s2),
  f AS (SELECT s2.*, NOT held.held AND row_number() OVER (PARTITION BY s2.section ORDER BY live_state DESC, coalesce(rs, 0) DESC, s2.id DESC) = 1 AS top FROM s2 JOIN held ON s2.section = held.section WHERE NOT exempt),
  c AS (SELECT id, sum(b + CASE WHEN top THEN head ELSE 0 END) OVER w AS bs, sum(CASE WHEN top THEN 3 ELSE 1 END) OVER w AS ns FROM f WINDOW w AS (ORDER BY live_state DESC, coalesce(rs, 0) DESC, id DESC ROWS UNBOUNDED PRECEDING)),
  told AS (SELECT c.id, CASE WHEN bs + fixed.b - 1 > {_BUDGET} THEN 'budget' WHEN ns + fixed.n > {_LINES} THEN 'lines' END AS reason FROM c CROSS JOIN fixed UNION ALL SELECT id, NULL FROM s2 WHERE exempt
    UNION ALL SELECT id, 'section_budget' FROM s1 WHERE shed UNION ALL SELECT id, 'unsectioned' FROM e WHERE section IS NULL)"""


@query("digest_budget", f"{DIGEST} SELECT id, reason IS NULL AS kept, reason FROM told")
def _(s):
    """What the digest leaves out and why: sections under their own cap, then limits of bytes and lines at once. Literals and pins
    grow with the store; once they fill the digest alone, all others are left out."""
    return digest.digest(s.sql(ENTRIES), _BUDGET, _LINES, caps=_CAP, strict=False)


@query("digest_render", "SELECT source_ref, string_agg(id || ' ' || channel, chr(10) ORDER BY id DESC) AS body FROM (SELECT *, row_number() OVER (PARTITION BY source_ref ORDER BY id DESC) AS r FROM {src} WHERE tombstoned = 0 AND redacted = 0 AND archived = 0 AND status <> 'quarantined') x WHERE r <= 12 GROUP BY source_ref")
def _(s):
    w = Window.partitionBy("source_ref").orderBy(F.desc("id"))
    top = s.src.where(filters.untainted()).withColumn("r", F.row_number().over(w)).where("r <= 12")
    parts = top.groupBy("source_ref").agg(F.array_sort(F.collect_list(F.struct("r", F.concat_ws(" ", F.col("id").cast("string"), "channel").alias("t")))).alias("p"))
    return parts.select("source_ref", F.array_join(F.transform("p", lambda p: p["t"]), "\n").alias("body"))


@query("stride_sample", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY source_ref ORDER BY id) AS i FROM {src}) x WHERE floor(i * 0.3) > floor((i - 1) * 0.3)")
def _(s):
    """A deterministic share of each source at even strides, numbered by a scan, so no task holds a source."""
    rows = scan.running_sums(s.src.select("id", "source_ref", F.lit(1).cast("long").alias("i")), ["source_ref"], ["id"], ["i"])
    rate = F.lit(0.3).cast("decimal(4,2)")
    return rows.where(F.floor(F.col("i_sum") * rate) > F.floor((F.col("i_sum") - 1) * rate)).select("id")


@query("mrl_vectors", """SELECT vec_id, k - 1 AS k, round(v / norm, 5) AS x FROM (SELECT vec_id, unnest(embedding[1:16]::DOUBLE[]) AS v, generate_subscripts(embedding[1:16], 1) AS k,
  sqrt(list_sum(list_transform(embedding[1:16]::DOUBLE[], lambda x: x * x))) AS norm FROM {embeddings}) y""")
def _(s):
    """Every component of the shortened vectors, which are unit vectors again."""
    return s.embeddings.select("vec_id", F.posexplode(V.mrl(F.col("embedding"), 16)).alias("k", "v")).select("vec_id", F.col("k").cast("long").alias("k"), F.round("v", 5).alias("x"))


@query("instruction_pairs", "SELECT id, CASE WHEN starts_with(content, 'Q: ') THEN substr(content, 4, 200) ELSE substr(content, 1, 200) END AS instruction FROM {der}")
def _(s):
    return s.der.select("id", F.when(F.startswith("content", F.lit("Q: ")), F.substring("content", 4, 200)).otherwise(F.substring("content", 1, 200)).alias("instruction"))


@query("session_floor_stream", "SELECT session_id, least(2, coalesce(min(taint), 2)) AS floor FROM {sessions} GROUP BY session_id")
def _(s):
    from ..streaming.sessions import run_available

    return run_available(s.spark, s.sf_dir, "events.parquet", s.events.schema)
