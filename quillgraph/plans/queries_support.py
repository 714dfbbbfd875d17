"""Queries of the supporting operators: prompt blocks, memory files, nodes' descriptions, tools, warm answers, benchmark items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, federation, filters, retrieval, support
from . import queries_text as X
from .queries_graph import POOL, STATE
from .views import Store

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


STRIP = r"regexp_replace(coalesce({c}, ''), '^\s+|\s+$', '', 'g')"
NAME = "CASE label WHEN 3 THEN 'ENDORSED' WHEN 2 THEN 'USER' WHEN 1 THEN 'AGENT-DERIVED' ELSE 'EXTERNAL' END"


# --- prompts -------------------------------------------------------------------------------------------------------------


_PROMPTS = "SELECT conv_id, turn, concat(CASE WHEN turn % 4 = 1 THEN '  /' ELSE ' ' END, substr(coalesce(text, ''), 1, CAST(conv_id % 25 AS INTEGER))) AS p FROM {conversations} WHERE role = 'user'"


@query("prompt_skip", f"SELECT conv_id, turn, length({STRIP.format(c='p')}) < 12 OR {STRIP.format(c='p')} LIKE '/%' AS skip FROM ({_PROMPTS}) x")
def _(s):
    return s.sql(_PROMPTS).select("conv_id", "turn", support.skip_prompt(F.col("p")).alias("skip"))


@query("prompt_block", rf"""WITH {X.QUERY_TERMS}, {X.BM25}, h AS (SELECT b.qid, b.id, b.score, CASE WHEN b.id % 3 > 0 THEN n.source_ref END AS name, trim(regexp_replace(n.content, '\s+', ' ', 'g')) AS hook FROM bm b JOIN {{src}} n ON n.id = b.id WHERE b.score >= 1.5),
  l AS (SELECT qid, id, score, '- [' || coalesce(name, 'mem:' || id) || ']' || CASE WHEN hook = '' THEN '' WHEN length(hook) > 90 THEN ' ' || rtrim(substr(hook, 1, 89)) || '…' ELSE ' ' || hook END AS line FROM h),
  t AS (SELECT *, 18 + sum(strlen(line) + 1) OVER (PARTITION BY qid ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS total FROM l)
  SELECT qid, count(*) AS n, 'Relevant memories:' || chr(10) || string_agg(line, chr(10) ORDER BY total) AS block FROM t WHERE total <= 600 GROUP BY qid""")
def _(s):
    """The block of remembered lines that goes before a prompt, for each benchmark query. Only hits that may fit, a line takes five bytes
    at least, meet their texts."""
    scores = retrieval.bm25(X.lexical(s, X.queries_of(s)), X.queries_of(s)).where("score >= 1.5")
    scores = retrieval.ranked(scores, support.BLOCK_BYTES // 5).select("qid", "id", "score")
    hits = scores.join(s.src.select("id", F.when(F.col("id") % 3 > 0, F.col("source_ref")).alias("name"), F.col("content").alias("hook")), "id")
    return support.prompt_blocks(hits, 1.5)


# --- memory files --------------------------------------------------------------------------------------------------------


_COPIES = "SELECT stem AS name, concat(dir, '/', stem, '-', CAST(id AS STRING), '.md') AS path, depth, mtime, CASE WHEN id % 97 < 30 THEN 'same' ELSE content END AS content FROM {files} WHERE id % 97 < 60 OR id < 97"


@query("heal_duplicates", f"""WITH f AS ({_COPIES}), g AS (SELECT name, count(*) AS n, count(DISTINCT content) = 1 AS equal, max_by(path, {{depth: depth, path: path}}) AS deepest, max_by(path, {{mtime: mtime, depth: depth, path: path}}) AS newest FROM f GROUP BY name),
  k AS (SELECT name, CASE WHEN equal THEN deepest ELSE newest END AS kept, CASE WHEN equal THEN 'delete' ELSE 'quarantine' END AS action FROM g WHERE n > 1)
  SELECT f.name, k.kept, f.path AS dropped, k.action, CASE WHEN k.action = 'quarantine' THEN '.weights/dup_quarantine/' || f.name || '.' || f.mtime || '.md' END AS moved_to FROM f JOIN k ON k.name = f.name WHERE f.path <> k.kept""")
def _(s):
    return support.heal_duplicates(s.sql(_COPIES))


_FILED = """SELECT id, concat(CASE id % 3 WHEN 0 THEN 'feedback_' WHEN 1 THEN 'feedback_cluster_' ELSE 'project_' END, CAST(id AS STRING)) AS stem, CASE id % 4 WHEN 0 THEN ' feedback' WHEN 3 THEN 'Projects' ELSE 'Feedback' END AS section,
  id % 5 = 1 AS curated, CASE WHEN id % 7 = 2 THEN 'own' WHEN id % 7 = 3 THEN '  ' END AS own_line, id % 2 = 0 AS known, CASE WHEN id % 8 = 2 THEN 'needs_cluster' END AS pending FROM {src}"""


@query("born_unindexed", f"SELECT id, stem, stem LIKE 'feedback\\_%' ESCAPE '\\' AND stem NOT LIKE 'feedback\\_cluster\\_%' ESCAPE '\\' AND NOT curated AND trim(coalesce(own_line, '')) = '' AND lower(trim(section)) = 'feedback' AND (NOT known OR coalesce(pending = 'needs_cluster', FALSE)) AS held_back FROM ({_FILED}) x")
def _(s):
    return s.sql(_FILED).select("id", "stem", support.born_unindexed(*map(F.col, ("stem", "section", "curated", "own_line", "known", "pending"))).alias("held_back"))


_MEMORIES = """SELECT id, tombstoned, CASE id % 4 WHEN 3 THEN source_ref WHEN 2 THEN concat('memory:literal:', CAST(id AS STRING)) ELSE concat('memory:', CASE id % 7 WHEN 0 THEN 'user' WHEN 1 THEN 'feedback' WHEN 2 THEN 'project' WHEN 3 THEN 'personal' WHEN 4 THEN 'fact' WHEN 5 THEN 'odd' ELSE 'reference' END, '_', CAST(id AS STRING)) END AS source_ref,
  CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN 'agent-derived' ELSE channel END AS channel, CASE WHEN id % 3 > 0 THEN CAST(id % 10 AS DOUBLE) / 10 END AS forget_rs, CASE WHEN id % 6 > 0 THEN id % 6 END AS forget_count,
  CASE WHEN id % 9 = 0 THEN 'cold' END AS forget_tier, CASE WHEN id % 13 = 0 THEN ' Yes' WHEN id % 13 = 1 THEN 'no' END AS pin FROM {src}"""


@query("memory_rows", f"""SELECT stem, CASE WHEN head IN ('user', 'feedback', 'project', 'personal', 'reference') THEN head ELSE 'other' END AS type,
  CASE WHEN channel = 'agent-derived' THEN 'agent' WHEN channel IS NOT NULL THEN channel WHEN head IN ('user', 'feedback', 'personal') THEN 'endorsed' ELSE 'user' END AS channel,
  coalesce(forget_rs, 1.0)::DOUBLE AS weight, coalesce(forget_count, 0)::BIGINT AS count, coalesce(forget_tier, 'hot') AS tier, coalesce(channel = 'endorsed', FALSE) OR lower(trim(coalesce(pin, ''))) = 'yes' AS pinned
  FROM (SELECT *, substr(source_ref, 8) AS stem, split_part(substr(source_ref, 8), '_', 1) AS head FROM ({_MEMORIES}) y WHERE tombstoned = 0 AND source_ref LIKE 'memory:%' AND source_ref NOT LIKE 'memory:literal:%') x""")
def _(s):
    """The telemetry's rows of live memory files."""
    return support.memory_rows(s.sql(_MEMORIES))


_PROJECTS = "SELECT id, CASE WHEN id % 4 > 0 THEN id - id % 4 END AS parent, CASE id % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'closed' WHEN 2 THEN 'someday' WHEN 3 THEN 'parked' END AS status, CASE id % 3 WHEN 0 THEN 'cold' WHEN 1 THEN 'warm' END AS tier FROM {src}"


@query("project_groups", f"""WITH p AS ({_PROJECTS}), m(status, g) AS (VALUES ('active', 'Active'), ('parked', 'Parked'), ('closed', 'Closed'))
  SELECT p.id, coalesce(m.g, mu.g, CASE p.tier WHEN 'cold' THEN 'Closed' WHEN 'warm' THEN 'Parked' ELSE 'Active' END) AS "group" FROM p LEFT JOIN p u ON u.id = p.parent LEFT JOIN m ON m.status = p.status LEFT JOIN m mu ON mu.status = u.status""")
def _(s):
    return support.project_groups(s.sql(_PROJECTS))


_ENTRIES = "SELECT source_ref AS doc, CASE WHEN id % 6 > 0 THEN concat('note-', CAST(id % 40 AS STRING), '.md') END AS file, id FROM {src}"


@query("entry_counts", f"SELECT doc, count(DISTINCT file) AS files, count(*) FILTER (WHERE file IS NULL) AS literals FROM ({_ENTRIES}) x GROUP BY doc")
def _(s):
    return support.entry_counts(s.sql(_ENTRIES))


@query("compare_index", f"""WITH e AS (SELECT doc AS section, file, id FROM ({_ENTRIES}) x WHERE file IS NOT NULL), r AS (SELECT DISTINCT section, file FROM e WHERE id % 7 > 2), w AS (SELECT DISTINCT section, file FROM e WHERE id % 5 > 1)
  SELECT *, 'missing' AS kind FROM (FROM r EXCEPT FROM w) a UNION ALL SELECT *, 'extra' FROM (FROM w EXCEPT FROM r) b""")
def _(s):
    """What an index and its shadow, rendered from the store, do not share."""
    e = s.sql(_ENTRIES).where("file is not null").select(F.col("doc").alias("section"), "file", "id")
    return support.compare_index(e.where("id % 7 > 2"), e.where("id % 5 > 1"))


# --- nodes ---------------------------------------------------------------------------------------------------------------


@query("replay_parents", f"SELECT e.child, row_number() OVER (PARTITION BY e.child ORDER BY n.label DESC, e.parent) AS pos, e.parent, n.label FROM {{edges}} e JOIN {{nodes}} n ON n.id = e.parent WHERE {POOL}")
def _(s):
    return support.replay_parents(s.edges, s.nodes.where(filters.untainted()))


@query("recipes", """SELECT id, engine, engine IN ('compose', 'extractive') AS deterministic, question, k FROM (SELECT id, CASE id % 3 WHEN 0 THEN 'compose' WHEN 1 THEN 'extractive' ELSE 'llm' END AS engine, CASE WHEN id % 4 > 0 THEN 'q "' || conv_id || '"' END AS question, CASE WHEN id % 4 > 1 THEN turn::BIGINT END AS k FROM {der}) x""")
def _(s):
    """How each derived node was made, recorded as text and read back."""
    engine = F.when(F.col("id") % 3 == 0, "compose").when(F.col("id") % 3 == 1, "extractive").otherwise("llm")
    question, k = F.when(F.col("id") % 4 > 0, F.concat(F.lit('q "'), F.col("conv_id").cast("string"), F.lit('"'))), F.when(F.col("id") % 4 > 1, F.col("turn").cast("long"))
    rows = s.der.select("id", support.recipe(engine, question=question, k=k).alias("r")).select("id", "r.engine", F.from_json("r.recipe", "question string, k long").alias("o"))
    return rows.select("id", "engine", F.col("engine").isin(*support.DETERMINISTIC).alias("deterministic"), "o.question", "o.k")


_NEW_REL = "SELECT id AS a, CASE WHEN id % 5 = 0 THEN id WHEN id % 5 = 1 THEN id + 100000000 ELSE id - id % 5 END AS b, CASE WHEN id % 2 = 0 THEN 'follows' ELSE 'relates-to' END AS kind FROM {src}"


@query("relate", f"SELECT a, b, 'follows' AS kind FROM {{rel}} UNION SELECT a, b, kind FROM ({_NEW_REL}) x WHERE a <> b AND b IN (SELECT id FROM {{nodes}})")
def _(s):
    twice = s.sql(_NEW_REL).unionByName(s.sql(_NEW_REL).where("a % 3 = 0"))
    return support.relate(s.rel.withColumn("kind", F.lit("follows")), twice, s.nodes)


@query("offered_tools", """SELECT 'store.' || tool AS name FROM (VALUES ('ask'), ('explain')) o(tool) UNION ALL
  SELECT server || '.' || tool FROM (SELECT DISTINCT 's' || user_id AS server, event_type AS tool, user_id FROM {events}) u WHERE NOT (user_id % 5 = 1 AND tool <> 'error')""")
def _(s):
    """All tools below the names of their servers, but those whose schema changed since it was pinned."""
    own = s.spark.createDataFrame([("ask",), ("explain",)], "tool string")
    up = s.events.select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("server"), F.col("event_type").alias("tool"), "user_id").distinct()
    now = F.sha2(F.col("tool"), 256)
    pinned = F.when(F.col("user_id") % 5 != 0, F.when((F.col("user_id") % 5 == 1) & (F.col("tool") != "error"), F.sha2(F.concat("tool", F.lit("*")), 256)).otherwise(now))
    return support.offered_tools(own, up.withColumn("schema_hash", now).withColumn("pinned_hash", pinned), "store")


_CACHE = "SELECT concat('q', CAST(conv_id AS STRING)) AS query, min(id) AS node, CAST(max(turn) AS BIGINT) AS hits FROM {der} GROUP BY conv_id"
_ASKED = "SELECT concat('q', CAST(user_id AS STRING)) AS query FROM {events}"


@query("serve_warm", f"""SELECT c.query, a.asks, CASE WHEN p.id IS NOT NULL THEN c.node END AS node, c.hits + CASE WHEN p.id IS NOT NULL THEN a.asks ELSE 0 END AS hits, p.id IS NULL AS dropped
  FROM ({_CACHE}) c JOIN (SELECT query, count(*) AS asks FROM ({_ASKED}) x GROUP BY query) a ON a.query = c.query LEFT JOIN (SELECT id FROM {{der}} WHERE {POOL}) p ON p.id = c.node""")
def _(s):
    return support.serve_warm(s.sql(_ASKED), s.sql(_CACHE), s.der.where(filters.untainted()))


@query("describe_nodes", f"""SELECT id, '[' || id || '] ' || channel || '  integrity=' || {NAME} || '  ' || {STATE} || chr(10) || '      ' || source_ref || chr(10) || '      "' || CASE WHEN redacted = 1 THEN '[REDACTED]' ELSE snippet || '...' END || '"' AS text
  FROM {{nodes}} JOIN ({X.ORACLES['text_snippets']}) t USING (id)""")
def _(s):
    return s.nodes.select("id", support.describe(filters.node_state()).alias("text"))


_CONSOLIDATED = """SELECT id, label, id % 4 + 2 AS parents, CASE WHEN id % 3 = 0 THEN concat('  - ', replace(substr(content, 1, 150), ' the ', chr(10)), '.', chr(10), '- second point..', chr(10), '- x', chr(10), '- third', chr(10), 'plain', chr(10), '- fourth', chr(10), '- fifth')
  WHEN id % 3 = 1 THEN concat(chr(10), ' ', substr(content, 1, 260), '..') ELSE '' END AS content FROM {src}"""


@query("house_answers", rf"""WITH c AS (SELECT *, list_transform(string_split(content, chr(10)), lambda x: {STRIP.format(c='x')}) AS lines FROM ({_CONSOLIDATED}) y),
  b AS (SELECT *, list_transform(list_filter(lines, lambda x: x LIKE '- %' AND length(x) > 4), lambda x: {STRIP.format(c='substr(x, 3)')}) AS bs, coalesce(list_filter(lines, lambda x: x <> '')[1], '') AS first FROM c),
  p AS (SELECT *, CASE WHEN len(bs) > 0 THEN bs ELSE [rtrim(substr(regexp_replace(trim(regexp_replace(first, '\s+', ' ', 'g')), '\.+$', ''), 1, 200))] END AS ps FROM b)
  SELECT id, 'Verdict: ' || regexp_replace(ps[1], '\.+$', '') || '.' || chr(10) || 'Evidence:' || chr(10) || array_to_string(list_transform(ps[1:4], lambda x: '- ' || regexp_replace(x, '\.+$', '') || '. [mem:' || id || '|agent-derived]'), chr(10))
    || chr(10) || 'Integrity: ' || {NAME} || ' (floor of ' || parents || ' episodes)' || chr(10) || 'Next move: treat as ' || {NAME} || ' - walk its provenance before acting on it.' AS answer FROM p""")
def _(s):
    return s.sql(_CONSOLIDATED).select("id", support.house_answer(F.col("id"), F.col("content"), F.col("label"), F.col("parents")).alias("answer"))


_ITEM = """SELECT conv_id AS id, CASE conv_id % 5 WHEN 0 THEN 'temporal' WHEN 1 THEN NULL WHEN 2 THEN 'knowledge-update' WHEN 3 THEN 'single-session-user' ELSE 'single-session-assistant' END AS type, concat('What of ', CAST(conv_id AS STRING), '??') AS question,
  CASE conv_id % 7 WHEN 0 THEN '  ' WHEN 1 THEN ' Yes ' WHEN 2 THEN 'false' ELSE concat('gold ', CAST(conv_id AS STRING)) END AS answer FROM {conversations} GROUP BY conv_id"""
_TURNS = "SELECT conv_id AS id, turn, coalesce(text, '') AS content, conv_id % 11 > 1 AND turn % 3 = 1 AS has_answer FROM {conversations} WHERE conv_id >= 0"


@query("memory_items", rf"""WITH t AS (SELECT id, turn, {STRIP.format(c='content')} AS text, has_answer FROM ({_TURNS}) x), u AS (SELECT *, row_number() OVER (PARTITION BY id, has_answer ORDER BY turn, text) AS r FROM t WHERE text <> ''),
  n AS (SELECT id, count(*) FILTER (WHERE has_answer) AS bearing, count(*) FILTER (WHERE NOT has_answer) AS others FROM u GROUP BY id),
  i AS (SELECT *, trim(answer) AS gold FROM ({_ITEM}) y WHERE y.id >= 0), j AS (SELECT i.*, coalesce(n.bearing, 0) AS bearing, coalesce(n.others, 0) AS others, CASE WHEN coalesce(type, 'unknown') NOT IN ('single-session-user', 'single-session-assistant', 'knowledge-update') THEN coalesce(type, 'unknown') WHEN trim(answer) = '' THEN 'empty-answer' WHEN coalesce(n.bearing, 0) = 0 THEN 'no-answer-turn' END AS skipped FROM i LEFT JOIN n ON n.id = i.id),
  e AS (SELECT u.id, sha256(string_agg(u.text, chr(10) ORDER BY u.has_answer DESC, u.r)) AS texts FROM u JOIN n ON n.id = u.id WHERE u.has_answer OR u.r <= greatest(6 - n.bearing, 0) GROUP BY u.id)
  SELECT j.id, skipped, CASE WHEN skipped IS NULL THEN gold END AS gold, CASE WHEN skipped IS NULL THEN bearing + least(others, greatest(6 - bearing, 0)) END AS n_evidence, CASE WHEN skipped IS NULL THEN texts END AS texts,
    CASE WHEN skipped IS NULL THEN 'What of ' || j.id || '? Authoritative correction: ' || CASE lower(gold) WHEN 'yes' THEN 'no' WHEN 'no' THEN 'yes' WHEN 'true' THEN 'false' WHEN 'false' THEN 'true' ELSE 'definitely-not-' || gold END || '.' END AS poison FROM j LEFT JOIN e ON e.id = j.id""")
def _(s):
    """Benchmark items from long conversations, whose turns come as nested lists."""
    turns = s.sql(_TURNS).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("turn", "content", "has_answer"))).alias("l"))
    turns = turns.select("id", F.array(F.transform("l", lambda t: F.struct(t["content"].alias("content"), t["has_answer"].alias("has_answer")))).alias("sessions"))
    items = support.memory_items(s.sql(_ITEM).where("id >= 0").join(turns, "id", "left"))
    none = lambda c: F.when(F.col("skipped").isNull(), c)
    return items.select("id", "skipped", "gold", none(F.size("evidence").cast("long")).alias("n_evidence"), none(F.sha2(F.array_join(F.transform("evidence", lambda e: e["text"]), "\n"), 256)).alias("texts"), "poison")


@query("elevation_log", "SELECT e.id, e.from_label, e.to_label, n.channel, n.tombstoned FROM {elevations} e JOIN {nodes} n ON n.id = e.id")
def _(s):
    """What has been raised above its derived label, with the node's present state."""
    return s.elevations.join(s.nodes.select("id", "channel", "tombstoned"), "id").select("id", "from_label", "to_label", "channel", "tombstoned")


# --- audit ---------------------------------------------------------------------------------------------------------------


_MEMORY_FILES = """SELECT concat(stem, '.md') AS file, stem, CASE WHEN id % 9 > 0 THEN concat('Title-', CAST(id AS STRING)) END AS name, CASE id % 8 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'text' END AS description,
  CASE id % 10 WHEN 0 THEN NULL WHEN 1 THEN 'odd' WHEN 2 THEN 'fact' ELSE 'project' END AS type, CASE WHEN id % 12 = 0 THEN ' None' END AS section, CASE id % 15 WHEN 4 THEN 'No' WHEN 5 THEN 'true' END AS in_index,
  CASE id % 11 WHEN 1 THEN 'unsectioned' WHEN 2 THEN 'needs_cluster' WHEN 3 THEN 'budget' WHEN 4 THEN 'cold' END AS reason,
  concat(substr(content, 1, 40), ' [[', CASE id % 5 WHEN 0 THEN concat('TITLE_', CAST(id + 1 AS STRING)) WHEN 1 THEN concat('note-', CAST(id + 3 AS STRING)) WHEN 2 THEN concat('Gone-', CAST(id % 6 AS STRING)) WHEN 3 THEN 'no link|x' ELSE 'gone-1]] [[gone-1' END, ']]') AS content
  FROM (SELECT id, content, concat('note_', CAST(id AS STRING)) AS stem FROM {src}) f"""
_LINKED = "SELECT concat('note_', CAST(id AS STRING), '.md') AS file FROM {src} WHERE id % 3 = 0 UNION ALL SELECT concat('lost_', CAST(id AS STRING), '.md') FROM {src} WHERE id % 50 = 0"
_TIERS = "SELECT concat('note_', CAST(id AS STRING)) AS stem, CASE WHEN id % 4 = 0 THEN 'cold' ELSE 'hot' END AS tier FROM {src} WHERE id % 7 > 1"


@query("audit_findings", rf"""WITH f AS ({_MEMORY_FILES}), l AS (SELECT DISTINCT file FROM ({_LINKED}) x), t AS ({_TIERS}),
  o AS (SELECT f.*, CASE WHEN f.reason = 'unsectioned' OR lower(trim(coalesce(section, ''))) = 'none' OR lower(trim(coalesce(in_index, ''))) IN ('false', 'no', '0') THEN 'withdrawn' WHEN f.reason = 'needs_cluster' THEN 'needs-cluster'
    WHEN f.reason IN ('budget', 'lines', 'projects', 'section_budget') THEN NULL WHEN t.stem IS NULL THEN 'pending-import' ELSE 'orphan-file' END AS kind FROM f LEFT JOIN t ON t.stem = f.stem WHERE f.file NOT IN (FROM l) AND coalesce(t.tier, 'hot') <> 'cold'),
  w AS (SELECT DISTINCT file, unnest(regexp_extract_all(content, '(?i)\[\[([a-z0-9][a-z0-9_-]*)\]\]', 1)) AS target FROM f), k AS (SELECT lower(replace(stem, '_', '-')) AS k FROM f UNION SELECT lower(replace(name, '_', '-')) FROM f WHERE name IS NOT NULL)
  SELECT kind AS name, CASE kind WHEN 'orphan-file' THEN 'ERROR' ELSE 'INFO' END AS severity, file AS target, NULL::VARCHAR AS detail FROM o WHERE kind IS NOT NULL
  UNION ALL SELECT 'dead-index-link', 'ERROR', file, NULL FROM l WHERE file NOT IN (SELECT file FROM f)
  UNION ALL SELECT 'frontmatter-missing', 'ERROR', file, concat_ws(', ', CASE WHEN coalesce(name, '') = '' THEN 'name' END, CASE WHEN coalesce(description, '') = '' THEN 'description' END, CASE WHEN coalesce(type, '') = '' THEN 'type' END) FROM f WHERE coalesce(name, '') = '' OR coalesce(description, '') = '' OR coalesce(type, '') = ''
  UNION ALL SELECT 'bad-type', 'WARN', file, type FROM f WHERE type = 'odd'
  UNION ALL SELECT 'broken-wikilink', 'INFO', target, count(*)::VARCHAR FROM w WHERE lower(replace(target, '_', '-')) NOT IN (FROM k) GROUP BY target
  UNION ALL SELECT 'budget-breach', 'WARN', 'index', '500'""")
def _(s):
    """Where memory files, their index and the store disagree."""
    return audit.audit(s.sql(_MEMORY_FILES), s.sql(_LINKED), s.sql(_TIERS), 2500, 2000)


# --- changesets ----------------------------------------------------------------------------------------------------------


_U = "concat('n', CAST({c} AS STRING))"
_LOCAL = f"SELECT {_U.format(c='id')} AS uuid, content, channel, label, conf_label, status, tombstoned, redacted, CASE id % 3 WHEN 0 THEN 'peer' WHEN 1 THEN 'home' END AS origin FROM {{nodes}} WHERE id % 5 <> 0"
_SENT = f"""SELECT {_U.format(c='id')} AS uuid, concat(content, ' (theirs)') AS content, CASE WHEN id % 16 = 0 THEN 'odd' ELSE channel END AS channel, CASE id % 6 WHEN 0 THEN '7' WHEN 2 THEN 'x' ELSE CAST(label AS STRING) END AS label,
  CASE WHEN id % 10 = 0 THEN '-4' WHEN id % 10 = 2 THEN NULL ELSE CAST(conf_label AS STRING) END AS conf_label, CASE WHEN id % 14 = 4 THEN 'quarantined' WHEN id % 22 = 0 THEN 'odd' ELSE status END AS status,
  CASE WHEN id % 7 = 2 THEN 1 ELSE 0 END AS tombstoned, CASE WHEN id % 26 = 6 THEN 1 ELSE 0 END AS redacted, 'peer' AS origin FROM {{nodes}} WHERE id % 2 = 0 OR id % 5 = 0"""
_LOCAL_EDGES = f"SELECT {_U.format(c='child')} AS child, {_U.format(c='parent')} AS parent FROM {{edges}} WHERE child % 5 <> 0 AND parent % 5 <> 0 AND (child + parent) % 4 <> 0"
_SENT_EDGES = f"SELECT {_U.format(c='child')} AS child, {_U.format(c='parent')} AS parent FROM {{edges}} WHERE (child + parent) % 3 <> 1"
_RECORDS = {True: f"SELECT {_U.format(c='id')} AS uuid FROM {{nodes}} WHERE id % 28 = 3 OR id % 46 = 8", False: f"SELECT {_U.format(c='id')} AS uuid FROM {{nodes}} WHERE id % 28 = 3"}


def _import_sql(trusted: bool) -> str:
    t, least = ("TRUE", 0) if trusted else ("FALSE", 1)
    return f"""WITH RECURSIVE lo AS ({_LOCAL}), sn AS ({_SENT}), rc AS ({_RECORDS[trusted]}), le AS ({_LOCAL_EDGES}), se AS ({_SENT_EDGES}),
  b AS (SELECT coalesce(l.uuid, i.uuid) AS uuid, l.uuid IS NULL AS fresh, i.uuid IS NOT NULL AS came, coalesce(l.origin, '') = 'peer' AS owned, coalesce(l.uuid, i.uuid) IN (FROM rc) AS rec,
    CASE WHEN {t} AND i.channel IN ('endorsed', 'user', 'agent-derived', 'external') THEN i.channel ELSE 'external' END AS ch, l.content AS lc, l.channel AS lch, l.label AS ll, l.conf_label AS lf, l.status AS ls, l.tombstoned AS lt, l.redacted AS lr, l.origin AS lorig,
    i.content AS ic, i.label AS il, i.conf_label AS icf, i.status AS ist, i.tombstoned AS it, i.redacted AS ir FROM lo l FULL OUTER JOIN sn i ON i.uuid = l.uuid),
  m AS (SELECT uuid, fresh, CASE WHEN fresh THEN ch ELSE lch END AS channel, CASE WHEN NOT fresh THEN ll WHEN ch = 'agent-derived' THEN least(3, greatest(0, coalesce(try_cast(il AS INTEGER), 0))) ELSE CASE ch WHEN 'endorsed' THEN 3 WHEN 'user' THEN 2 ELSE 0 END END AS label,
    CASE WHEN fresh THEN least(3, greatest({least}, coalesce(try_cast(icf AS INTEGER), {least}))) ELSE lf END AS conf_label, CASE WHEN fresh THEN CASE WHEN ist = 'quarantined' THEN ist ELSE 'live' END WHEN came AND owned AND ist = 'quarantined' THEN 'quarantined' ELSE ls END AS status,
    CASE WHEN fresh THEN it WHEN came AND owned THEN greatest(lt, it) ELSE lt END AS tombstoned, CASE WHEN fresh THEN greatest(ir, rec::INTEGER) WHEN came AND rec THEN 1 WHEN came AND owned THEN greatest(lr, ir) ELSE lr END AS redacted,
    CASE WHEN fresh THEN 'peer' ELSE lorig END AS origin, CASE WHEN fresh THEN ic ELSE lc END AS content, NOT fresh AND came AND owned AND it = 1 AND lt = 0 AS ends,
    CASE WHEN fresh THEN ir = 1 OR rec ELSE came AND lr = 0 AND (rec OR owned AND ir = 1) END AS scrubs, NOT fresh AND came AND owned AND ist = 'quarantined' AND ls = 'live' AS holds,
    CASE WHEN fresh OR NOT came THEN 0 ELSE (it = 0 AND lt = 1)::INTEGER + (ir = 0 AND lr = 1)::INTEGER + (ist = 'live' AND ls = 'quarantined')::INTEGER END AS blocked FROM b),
  ad AS (SELECT DISTINCT e.child, e.parent FROM se e JOIN m c ON c.uuid = e.child JOIN m p ON p.uuid = e.parent WHERE (c.fresh AND p.fresh OR {t} AND c.origin = 'peer') AND (e.child, e.parent) NOT IN (SELECT (child, parent) FROM le)),
  w AS (FROM le UNION ALL FROM ad), de AS (SELECT uuid FROM m WHERE ends UNION SELECT w.child FROM de JOIN w ON w.parent = de.uuid), sc AS (SELECT uuid FROM m WHERE scrubs UNION SELECT w.child FROM sc JOIN w ON w.parent = sc.uuid),
  a AS (SELECT m.* REPLACE (CASE WHEN uuid IN (FROM de) THEN 1 ELSE tombstoned END AS tombstoned, CASE WHEN uuid IN (FROM sc) THEN 1 ELSE redacted END AS redacted, CASE WHEN scrubs OR uuid IN (FROM sc) THEN '' ELSE content END AS content) FROM m),
  lv AS (SELECT w.* FROM w JOIN a ON a.uuid = w.parent WHERE a.tombstoned = 0 AND w.child IN (SELECT uuid FROM a WHERE channel = 'agent-derived')),
  up AS (SELECT uuid AS seed, uuid AS id FROM a UNION SELECT u.seed, v.parent FROM up u JOIN lv v ON v.child = u.id),
  ef AS (SELECT u.seed, min(a.label) AS label, max(a.conf_label) AS conf FROM up u JOIN a ON a.uuid = u.id WHERE u.id NOT IN (SELECT child FROM lv) GROUP BY u.seed)"""


def _imported(s: Store, trusted: bool, operator=federation.import_changeset):
    return operator(s.sql(_LOCAL), s.sql(_LOCAL_EDGES), s.sql(_SENT), s.sql(_SENT_EDGES), "peer", trusted, s.sql(_RECORDS[trusted]))


_AFTER = "SELECT a.uuid, a.channel, CASE WHEN a.tombstoned = 0 THEN ef.label ELSE a.label END AS label, CASE WHEN a.tombstoned = 0 THEN ef.conf ELSE a.conf_label END AS conf_label, a.status, a.tombstoned, a.redacted, a.origin, a.fresh, sha256(a.content) AS digest FROM a JOIN ef ON ef.seed = a.uuid"


@query("import_changeset", f"{_import_sql(True)} {_AFTER}")
def _(s):
    """The store after the changeset of a trusted origin: what is new, what was ended, and what that means for all derived nodes."""
    return _imported(s, True)["nodes"].withColumn("digest", F.sha2("content", 256)).drop("content")


@query("import_untrusted", f"{_import_sql(False)} {_AFTER}")
def _(s):
    """The same changeset without trust: new nodes are external, and no derivation of a known node is taken."""
    return _imported(s, False)["nodes"].withColumn("digest", F.sha2("content", 256)).drop("content")


@query("import_stats", f"{_import_sql(True)} SELECT count(*) FILTER (WHERE fresh) AS nodes_new, count(*) FILTER (WHERE ends OR scrubs AND NOT fresh OR holds) AS nodes_updated, sum(blocked)::BIGINT AS resurrections_blocked, (SELECT count(*) FROM ad) AS edges_new FROM m")
def _(s):
    return _imported(s, True, federation.import_stats)
