"""Queries over files that they write from the tables, and of the operators behind them: sources, codecs, code, scores, streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import vectors as V
from ..operators import code, filters, lifecycle, retrieval, scoring
from ..shared import materialise, shared_path
from ..sources import files, jsonl
from . import queries_text as X
from .views import Store

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("point_lookup", "SELECT id, channel, label, content FROM {src} WHERE id = 42")
def _(s):
    return s.src.where("id = 42").select("id", "channel", "label", "content")


# --- files ---------------------------------------------------------------------------------------------------------------


@query("scan_files", "SELECT source AS dir, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes, sum(length(coalesce(text, '')) + 1)::BIGINT AS chars FROM {documents} GROUP BY source")
def _(s):
    """Text files below one folder for each source, found by a recursive scan with a name filter."""
    root = shared_path(s.spark, "tree")
    s.documents.select(F.col("source").alias("dir"), F.coalesce("text", F.lit("")).alias("value")).write.partitionBy("dir").text(root)
    found = files.text_files(s.spark, root, "*.txt")
    return found.groupBy(F.regexp_extract("rel", r"^dir=([^/]+)/", 1).alias("dir")).agg(F.sum("bytes").cast("long").alias("bytes"), F.sum(F.length("text")).alias("chars"))


_PATHS = """SELECT id, CASE id % 9 WHEN 0 THEN '' WHEN 1 THEN '.obsidian/' WHEN 2 THEN 'projects/' WHEN 3 THEN 'projects/p' || id % 5 || '/' WHEN 4 THEN 'projects/p/q/' WHEN 5 THEN 'src/' WHEN 6 THEN 'node_modules/lib/' WHEN 7 THEN 'a/build/' ELSE 'deep/er/' END
  || CASE id % 7 WHEN 0 THEN 'note-' || id || '.md' WHEN 1 THEN 'MEMORY.md' WHEN 2 THEN '.#lock.md' WHEN 3 THEN 'tool.PY' WHEN 4 THEN 'old.md~' WHEN 5 THEN 'lib.tar.gz' ELSE 'X.MD' END AS rel, length(content) * 40 AS bytes FROM {src}"""


@query("tree_paths", rf"""WITH p AS ({_PATHS}), q AS (SELECT *, string_split(rel, '/')[:-2] AS dirs, string_split(rel, '/')[-1] AS name FROM p)
  SELECT id, lower(rel) LIKE '%.md' AND NOT regexp_matches(name, '^\..*\.tmp$|~$|^\.#|\.tmp$') AND NOT list_has_any(dirs, ['.obsidian', '.trash', '.git', '.sync', '.stfolder']) AS note,
    suffix(rel, '.md') AND name NOT IN ('MEMORY.md', 'INDEX.md') AND (len(dirs) = 0 OR (dirs[1] = 'projects' AND len(dirs) <= 2)) AS memory,
    lower(name) LIKE '%.py' AND NOT list_has_any(dirs, ['node_modules', 'build']) AND bytes <= 400000 AS code FROM q""")
def _(s):
    """Which paths are notes, memory files and code, by the predicates that the scans push to the listing."""
    folder = F.element_at(F.array(*(x if not isinstance(x, str) else F.lit(x) for x in ("", ".obsidian/", "projects/", F.concat(F.lit("projects/p"), (F.col("id") % 5).cast("string"), F.lit("/")), "projects/p/q/", "src/", "node_modules/lib/", "a/build/", "deep/er/"))), (F.col("id") % 9 + 1).cast("int"))
    name = F.element_at(F.array(*(x if not isinstance(x, str) else F.lit(x) for x in (F.concat(F.lit("note-"), F.col("id").cast("string"), F.lit(".md")), "MEMORY.md", ".#lock.md", "tool.PY", "old.md~", "lib.tar.gz", "X.MD"))), (F.col("id") % 7 + 1).cast("int"))
    rows = s.src.select("id", F.concat(folder, name).alias("rel"), (F.length("content") * 40).alias("bytes"))
    return rows.select("id", files.is_note(F.col("rel")).alias("note"), files.is_memory(F.col("rel")).alias("memory"), files.is_code(F.col("rel"), F.col("bytes")).alias("code"))


def _written(s: Store, name: str, rows) -> str:
    path = shared_path(s.spark, name)
    rows.write.text(path)
    return path


def _transcript(s: Store, rows, form: str):
    path = _written(s, "transcript", rows)
    found = jsonl.transcripts(s.spark, path, form, "*.txt")
    key = F.split(F.regexp_extract("text", r"^(\d+:\d+):", 1), ":")  # the writer puts its key before each text
    return found.select(key[0].cast("long").alias("conv_id"), key[1].cast("long").alias("turn"), "role", "channel", F.expr("substring(text, locate(':', text, locate(':', text) + 1) + 1)").alias("text"), F.regexp_extract("ref", r"#L(\d+)$", 1).cast("long").isNotNull().alias("has_ref"))


def _said():
    return F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"), F.lit(":"), F.coalesce("text", F.lit("")))


_TRANSCRIPT = "SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN 'user' ELSE 'agent-derived' END AS channel, {text} AS text, TRUE AS has_ref FROM {{conversations}} WHERE role IN ('user', 'assistant') AND turn % 5 <> 4"


@query("transcript_extract", _TRANSCRIPT.format(text="coalesce(text, '') || CASE WHEN turn % 2 = 1 THEN chr(10) || 'end' ELSE '' END"))
def _(s):
    """JSON transcript lines of the message form, a string or blocks as content, among damaged lines and other types."""
    blocks = F.array(F.struct(F.lit("text").alias("type"), _said().alias("text")), F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")), F.struct(F.lit("text").alias("type"), F.lit("end").alias("text")))
    odd = F.to_json(F.struct(F.col("role").alias("type"), F.struct(blocks.alias("content")).alias("message")))
    even = F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.col("role"), _said().alias("content")).alias("message")))
    line = F.when(F.col("turn") % 5 == 4, F.concat(F.lit("{broken "), F.col("role"))).when(F.col("turn") % 2 == 1, odd).otherwise(even)
    return _transcript(s, s.conversations.select(line.alias("value")), "message")


@query("transcript_payload", _TRANSCRIPT.format(text="coalesce(text, '')"))
def _(s):
    """The payload form: messages only, their event mirrors are dropped at the gate."""
    message = F.struct(F.when(F.col("turn") % 5 == 4, "function_call").otherwise("message").alias("type"), F.col("role"), F.array(F.struct(F.lit("input_text").alias("type"), _said().alias("text"))).alias("content"))
    mirror = F.to_json(F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit("user_message").alias("type"), _said().alias("message")).alias("payload")))
    both = F.array(F.to_json(F.struct(F.lit("response_item").alias("type"), message.alias("payload"))), mirror)
    return _transcript(s, s.conversations.select(F.explode(both).alias("value")), "payload")


@query("usage_events", "SELECT 's' || user_id AS stem, count(*) AS n, sum(event_id % 3)::BIGINT AS hits, min(strftime(ts, '%Y-%m-%dT%H:%M:%SZ')) AS first_used, max(strftime(ts, '%Y-%m-%dT%H:%M:%SZ')) AS last_used FROM {events} WHERE date_trunc('second', ts) > TIMESTAMP '2024-01-10 00:00:00' AND event_id % 3 <> 0 AND event_id % 11 <> 0 GROUP BY user_id")
def _(s):
    """Usage logs as JSON lines, among damaged ones: uses after a cutoff, by stem."""
    use = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("stem"), (F.col("event_id") % 3).alias("hits")))
    path = _written(s, "usage", s.events.select(F.when(F.col("event_id") % 11 == 0, F.lit('{"ts": ')).otherwise(use).alias("value")))
    return jsonl.usage_by_stem(jsonl.usage_events(s.spark, path, "2024-01-10T00:00:00Z", "*.txt"))


@query("export_changeset", """SELECT 'node' AS kind, 'site:' || id AS uuid, NULL AS parent, content, label FROM {src} WHERE redacted = 0
  UNION ALL SELECT 'edge', 'site:' || child, 'site:' || parent, NULL, NULL FROM {edges} UNION ALL SELECT 'redaction', 'site:' || id, NULL, NULL, NULL FROM {src} WHERE redacted = 1
  UNION ALL SELECT 'header', 'site', NULL, NULL, NULL""")
def _(s):
    """A changeset, written with its header and read back."""
    uuid = lambda c: F.concat(F.lit("site:"), F.col(c).cast("string"))
    path = shared_path(s.spark, "changeset")
    nodes = s.src.where("redacted = 0").select(uuid("id").alias("uuid"), "content", "label")
    gone = s.src.where("redacted = 1").select(uuid("id").alias("uuid"), F.lit("2024-01-01T00:00:00+00:00").alias("redacted_at"))
    jsonl.write_changeset(path, "site", "2024-01-02T00:00:00+00:00", nodes, s.edges.select(uuid("child").alias("child"), uuid("parent").alias("parent")), gone)
    read = jsonl.read_changeset(s.spark, path, "uuid string, content string, label int")
    none = F.lit(None).cast("string")
    row = lambda df, kind, uuid, parent=none, content=none, label=F.lit(None): df.select(F.lit(kind).alias("kind"), F.col(uuid).alias("uuid"), parent.alias("parent"), content.alias("content"), label.cast("int").alias("label"))
    parts = (row(read["edges"], "edge", "child", F.col("parent")), row(read["redactions"], "redaction", "uuid"), row(read["header"], "header", "origin"))
    out = row(read["nodes"], "node", "uuid", content=F.col("content"), label=F.col("label"))
    for part in parts:
        out = out.unionByName(part)
    return out


@query("training_jsonl", "SELECT id, content AS response, label FROM {der} WHERE tombstoned = 0 AND label >= 1")
def _(s):
    """Records written as JSON lines and read back."""
    path = shared_path(s.spark, "training")
    jsonl.write_jsonl(s.der.where("tombstoned = 0 and label >= 1").select("id", F.col("content").alias("response"), "label"), path)
    v = F.col("v")
    return jsonl.records(s.spark, path, "*.txt").select(F.try_variant_get(v, "$.id", "long").alias("id"), F.try_variant_get(v, "$.response", "string").alias("response"), F.try_variant_get(v, "$.label", "int").alias("label"))


# --- upserts, codecs --------------------------------------------------------------------------------------------------------


@query("upsert_nodes", """SELECT coalesce(l.id, i.id) AS id, coalesce(i.label, l.label) AS upserted, coalesce(l.label, i.label) AS first_kept
  FROM (SELECT id, label FROM {src} WHERE id % 4 <> 0) l FULL OUTER JOIN (SELECT id, max(3 - label) AS label FROM {src} WHERE id % 3 = 0 GROUP BY id) i ON i.id = l.id""")
def _(s):
    """Insert or replace, and insert or ignore, by key; of several new rows with one key the greatest counts."""
    base = s.src.where("id % 4 <> 0").select("id", "label")
    new = s.src.where("id % 3 = 0").select("id", (3 - F.col("label")).alias("label"))
    both = lifecycle.upsert(base, new, "id").withColumnRenamed("label", "upserted")
    return both.join(lifecycle.upsert(base, new, "id", replace=False).withColumnRenamed("label", "first_kept"), "id")


@query("vector_codecs", """SELECT vec_id, 4 * len(embedding) AS f32_bytes, 2 * len(embedding) AS f16_bytes, TRUE AS f32_equal, TRUE AS f16_close, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM {embeddings}""")
def _(s):
    """Vectors as little-endian blobs of single and half precision, and back."""
    rows = s.embeddings.select("vec_id", "embedding", V.encode(F.col("embedding"), "f4").alias("a"), V.encode(F.col("embedding"), "f2").alias("b"))
    back = rows.withColumn("x", V.decode(F.col("a"), "f4")).withColumn("y", V.decode(F.col("b"), "f2"))
    close = F.forall(F.zip_with("embedding", "y", lambda p, q: F.abs(p - q) <= F.abs(p) * 0.001 + 0.0001), lambda ok: ok)
    total = F.round(F.aggregate(F.transform("x", lambda v: v.cast("double")), F.lit(0.0), lambda t, v: t + v), 4)
    return back.select("vec_id", F.length("a").alias("f32_bytes"), F.length("b").alias("f16_bytes"), F.forall(F.zip_with("embedding", "x", lambda p, q: p == q), lambda ok: ok).alias("f32_equal"), close.alias("f16_close"), total.alias("total"))


# --- code ---------------------------------------------------------------------------------------------------------------------


_CODE = """fl AS (SELECT id, source_ref AS repo, 'f' || id || '.txt' AS path, string_split(content, chr(10)) AS ls FROM {src}),
  wd AS (SELECT id, repo, path, unnest(range(0, len(ls), 60)) AS first, ls FROM fl), ch AS (SELECT id, repo, path, first, ls[first + 1 : first + 60] AS part FROM wd),
  ck AS (SELECT id * 1000 + first // 60 AS id, repo, path, first + 1 AS start_line, first + len(part) AS end_line, array_to_string(part, chr(10)) AS content FROM ch WHERE trim(array_to_string(part, '')) <> '')"""


def _code_chunks(s: Store):
    cut = code.chunk_files(s.src.select(F.col("id").alias("file_id"), F.col("source_ref").alias("repo"), F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".txt")).alias("path"), F.col("content").alias("text")))
    return cut.withColumn("id", F.col("file_id") * 1000 + F.floor((F.col("start_line") - 1) / code.WINDOW_LINES))


@query("code_index", f"WITH {_CODE} SELECT repo, path, count(*) AS chunks, sum(end_line - start_line + 1)::BIGINT AS lines FROM ck GROUP BY repo, path")
def _(s):
    """Files in windows of lines, blank ones left out, counted by repository and path."""
    return code.chunk_counts(_code_chunks(s))


@query("code_retrieve", f"""WITH {X.QUERY_TERMS}, {_CODE}, {X.BM25.replace(X.INDEX, "ix AS MATERIALIZED (SELECT id, content FROM ck WHERE repo IN ('src1', 'src2', 'src3', 'src4', 'src5'))")}
  SELECT qid, id, score, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM bm) x WHERE r <= 5""")
def _(s):
    """The best chunks of the repositories in scope."""
    scope = _code_chunks(s).where(F.col("repo").isin("src1", "src2", "src3", "src4", "src5"))
    return code.code_retrieve(scope.select("id", "content"), X.queries_of(s), 5).select("qid", "id", "score", "rank")


# --- contradiction evidence ------------------------------------------------------------------------------------------------------

_TOK = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(lower(regexp_replace({c}, '`[^`]+`', ' ', 'g')), '[*_#>|()\[\],:;!?]', ' ', 'g'), '\s+'), lambda t: trim(t, '.')), lambda t: t <> '')"
_NO = ", ".join(f"'{w}'" for w in T.NO_CLAIM)


@query("sentence_diff", rf"""WITH p AS (SELECT r.a, r.b, {_TOK.format(c="substr(x.content, 1, 160) || ' v1.2 x/y $5k word word'")} AS x, {_TOK.format(c="substr(y.content, 1, 160) || ' `code` 2024-01-02 word'")} AS y FROM {{rel}} r JOIN {{src}} x ON x.id = r.a JOIN {{src}} y ON y.id = r.b),
  d AS (SELECT a, b, list_filter(list_distinct(list_concat(x, y)), lambda t: len(list_filter(x, lambda u: u = t)) <> len(list_filter(y, lambda u: u = t))) AS d FROM p)
  SELECT a, b, array_to_string(list_sort(list_filter(d, lambda t: t NOT IN ({_NO}) AND regexp_matches(t, '\pL') AND NOT regexp_matches(t, '(?i)^(?:\$?\d[\d,.]*[km%]?|\[\[.*|https?:.*|[~./\\].*|.*[/\\].*|.*\.md)$'))), ' ') AS differ FROM d""")
def _(s):
    """The claim-bearing words that two texts do not hold equally often."""
    text = lambda c, more: T.claim_tokens(F.concat(F.substring(c, 1, 160), F.lit(more)))
    x = s.src.select(F.col("id").alias("a"), text("content", " v1.2 x/y $5k word word").alias("x"))
    y = s.src.select(F.col("id").alias("b"), text("content", " `code` 2024-01-02 word").alias("y"))
    return s.rel.join(x, "a").join(y, "b").select("a", "b", F.array_join(T.content_diff(F.col("x"), F.col("y")), " ").alias("differ"))


# --- benchmark scores ---------------------------------------------------------------------------------------------------------------

_CITES = f"{X.QUERY_TERMS}, {X.BM25}, {X.PIDS}, tp AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM bm WHERE id IN (SELECT id FROM pool)) x WHERE r <= 10), ci AS (SELECT tp.qid, s.* FROM tp JOIN {{src}} s ON s.id = tp.id)"


def _answers(s: Store):
    """An answer to each benchmark item: its ten best documents of the pool as citations."""
    top = retrieval.ranked(retrieval.bm25(X.lexical(s, X.queries_of(s)), X.queries_of(s)).join(X.pool_of(s), "id", "left_semi"), 10).select("qid", "id")
    cited = top.join(s.src, "id").groupBy("qid").agg(F.collect_list(F.struct(F.col("content").alias("text"), "channel")).alias("citations"), F.min("label").alias("low"), F.max("label").alias("high"), F.max("stale").alias("stale"))  # ten each
    rows = s.benchmark.select(F.col("item_id"), F.col("text").alias("evidence")).join(cited, F.col("item_id") == F.col("qid"), "left")
    return rows.withColumn("composed", F.col("qid").isNotNull()).withColumn("citations", F.coalesce("citations", F.array().cast("array<struct<text:string,channel:string>>")))


@query("integrity_metrics", f"""WITH {_CITES}, it AS (SELECT b.item_id, b.item_id % 2 = 0 AS poisoned, b.text AS evidence, split_part(b.text, ' ', 1) AS term FROM {{benchmark}} b),
  sc AS (SELECT it.item_id, any_value(it.poisoned) AS poisoned, count(ci.id) > 0 AS composed, coalesce(bool_or(contains(lower(ci.content), lower(it.evidence)) OR contains(lower(it.evidence), lower(ci.content))), FALSE) AS utility,
    coalesce(any_value(it.poisoned) AND bool_or(ci.channel = 'external'), FALSE) AS cited, coalesce(bool_or(contains(lower(ci.content), lower(it.term))), FALSE) AS said, CASE WHEN it.item_id % 3 = 0 THEN max(ci.label) ELSE min(ci.label) END AS integrity
    FROM it LEFT JOIN ci ON ci.qid = it.item_id GROUP BY it.item_id)
  SELECT count(*) AS n, count(*) FILTER (WHERE poisoned) AS n_poisoned, round(avg((NOT composed)::INT), 6) AS refusal_rate, round(avg(utility::INT), 6) AS utility, round(coalesce(avg((cited AND said)::INT) FILTER (WHERE poisoned), 0), 6) AS asr,
    round(coalesce(avg(cited::INT) FILTER (WHERE poisoned), 0), 6) AS citation_asr, round(coalesce(avg((cited AND integrity > 0)::INT) FILTER (WHERE poisoned), 0), 6) AS laundering_rate FROM sc""")
def _(s):
    """Utility, attacks and laundering of answers; every third item's answer claims its best source's label."""
    rows = _answers(s)
    items = rows.select("item_id", F.array("evidence").alias("evidence"), (F.col("item_id") % 2 == 0).alias("poisoned"), F.array(F.split("evidence", " ")[0]).alias("poison_terms"), F.lit("external").alias("poison_channel"))
    said = F.array_join(F.transform("citations", lambda c: c["text"]), "\n")
    answers = rows.select("item_id", "composed", said.alias("answer_text"), "citations", F.when(F.col("item_id") % 3 == 0, F.col("high")).otherwise(F.col("low")).alias("integrity"))
    return scoring.aggregate_items(scoring.score_items(items, answers))


@query("stale_metrics", f"""WITH {_CITES}, it AS (SELECT b.item_id, CASE WHEN b.item_id % 3 = 0 THEN 'control' ELSE 'updated' END AS kind, CASE WHEN b.item_id % 5 = 0 THEN '(prior note)' ELSE b.text END AS v1, d.content AS v2 FROM {{benchmark}} b LEFT JOIN {{src}} d ON d.id = b.item_id),
  sc AS (SELECT it.item_id, any_value(kind) = 'updated' AS upd, any_value(kind) = 'updated' AND any_value(v1) NOT LIKE '(prior note%' AS known, count(ci.id) > 0 AS composed, coalesce(max(ci.stale), 0) = 1 AS flagged,
    coalesce(bool_or(contains(lower(ci.content), lower(trim(v1))) OR contains(lower(trim(v1)), lower(ci.content))) FILTER (WHERE ci.content <> ''), FALSE) AS h1,
    coalesce(bool_or(contains(lower(ci.content), lower(trim(v2))) OR contains(lower(trim(v2)), lower(ci.content))) FILTER (WHERE ci.content <> '' AND v2 <> ''), FALSE) AS h2
    FROM it LEFT JOIN ci ON ci.qid = it.item_id GROUP BY it.item_id)
  SELECT count(*) AS n, count(*) FILTER (WHERE upd) AS n_updated, round(avg((NOT composed)::INT), 6) AS refusal_rate, round(coalesce(avg(h2::INT) FILTER (WHERE upd), 0), 6) AS fresh_present_rate, round(coalesce(avg(flagged::INT) FILTER (WHERE upd), 0), 6) AS flagged_rate,
    round(avg((h2 AND NOT h1)::INT) FILTER (WHERE known), 6) AS fresh_clean_rate, round(avg(h1::INT) FILTER (WHERE known), 6) AS served_stale_rate, count(*) FILTER (WHERE known) AS strict_serve_n, round(avg((flagged = upd)::INT), 6) AS attribution_accuracy FROM sc""")
def _(s):
    """Freshness after an update: the new text, the old one, disclosure, and whether the affected answers are the updated ones."""
    rows = _answers(s)
    v2 = s.src.select(F.col("id").alias("v2_id"), F.col("content").alias("v2"))
    items = rows.join(v2, F.col("item_id") == F.col("v2_id"), "left").select("item_id", F.when(F.col("item_id") % 3 == 0, "control").otherwise("updated").alias("kind"), F.when(F.col("item_id") % 5 == 0, "(prior note)").otherwise(F.col("evidence")).alias("v1"), "v2")
    stale = F.coalesce(F.col("stale") == 1, F.lit(False))
    return scoring.aggregate_stale(scoring.score_stale(items, rows.select("item_id", "composed", "citations", stale.alias("affected"), stale.alias("flagged"))))


# --- forgetting --------------------------------------------------------------------------------------------------------------------------

_MEMS = """SELECT DISTINCT user_id AS stem, CASE WHEN user_id % 4 = 1 THEN 'cold' ELSE 'hot' END AS tier, user_id % 17 = 0 AS pinned, user_id % 8 = 1 AS stashed, user_id % 13 = 0 AS is_stale, CASE WHEN user_id % 5 = 0 THEN (user_id % 100) / 100.0 END AS rs, CASE WHEN user_id % 10 = 0 THEN 0.5 END AS ss,
  CASE WHEN user_id % 5 = 1 THEN 0.7 END AS weight, CASE WHEN user_id % 3 = 0 THEN user_id % 6 END AS "count", CASE WHEN user_id % 5 = 2 THEN (user_id % 9) / 4.0 END AS salience, TIMESTAMP '2023-12-01 00:00:00' + INTERVAL 1 DAY * (user_id % 60) AS first_seen FROM {events}"""
_SEC = lambda c: f"epoch(date_trunc('second', {c}))"


@query("forget_tiers", f"""WITH RECURSIVE m AS ({_MEMS}), ev AS (SELECT stem, t, row_number() OVER (PARTITION BY stem ORDER BY t) AS n FROM (SELECT e.user_id AS stem, least({_SEC('e.ts')}, {_SEC("TIMESTAMP '2024-02-05'")}) AS t, unnest(range(e.event_id % 3)) AS k FROM {{events}} e) y WHERE stem NOT IN (SELECT stem FROM m WHERE is_stale)),
  f AS (SELECT stem, 0::BIGINT AS n, least(1.0::DOUBLE, coalesce(rs, weight, 1.0)::DOUBLE) AS rs, greatest(0.0::DOUBLE, least(3.0::DOUBLE, CASE WHEN rs IS NOT NULL THEN coalesce(ss, 0.0)::DOUBLE WHEN weight IS NOT NULL THEN 0.5::DOUBLE * ln(1 + coalesce("count", 0)) ELSE 3.0::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(salience, 0)::DOUBLE)) END)) AS ss, {_SEC('first_seen')} AS t FROM m
    UNION ALL SELECT f.stem, ev.n, least(1.0::DOUBLE, d.rs + 0.15::DOUBLE * (1 + ln(1 + d.ss))), d.ss, ev.t FROM f JOIN ev ON ev.stem = f.stem AND ev.n = f.n + 1,
      LATERAL (SELECT f.rs * CASE WHEN ev.t > f.t THEN pow(0.5::DOUBLE, (ev.t - f.t) / 604800.0::DOUBLE / (1 + f.ss)) ELSE 1 END AS r) a, LATERAL (SELECT a.r AS rs, greatest(0.0::DOUBLE, least(3.0::DOUBLE, f.ss + 0.1::DOUBLE * (1 - a.r))) AS ss) d),
  l AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY n DESC) AS k FROM f),
  x AS (SELECT m.*, l.n, round(l.rs * pow(0.5::DOUBLE, greatest(0, {_SEC("TIMESTAMP '2024-02-05'")} - l.t) / 604800.0::DOUBLE / (1 + l.ss)), 4) AS now_rs, floor(({_SEC("TIMESTAMP '2024-02-05'")} - {_SEC('first_seen')}) / 86400) AS age FROM l JOIN m USING (stem) WHERE k = 1)
  SELECT stem, coalesce("count", 0)::BIGINT + n AS "count", CASE WHEN pinned THEN 'hot' WHEN tier = 'hot' AND now_rs < 0.2 AND age >= 21 THEN 'cold' WHEN tier = 'cold' AND stashed AND now_rs >= 0.5 THEN 'hot' ELSE tier END AS tier, round(now_rs, 3) AS rs FROM x""")
def _(s):
    """Seeds of all three forms, hits, hysteresis, grace days and pins."""
    mems = s.sql(_MEMS.replace('"count"', "`count`"))
    out = lifecycle.forget_pass(mems.withColumn("last_used", F.lit(None).cast("timestamp")), s.events.select(F.col("user_id").alias("stem"), "ts", (F.col("event_id") % 3).alias("hits")), "2024-02-05")
    return out.select("stem", "count", "tier", F.round("rs", 3).alias("rs"))


# --- index notes ------------------------------------------------------------------------------------------------------------------------------

_INDEX = """SELECT source_ref AS doc, id AS pos, CASE WHEN id % 10 = 0 THEN '## part ' || CAST(id % 3 AS STRING) ELSE '- [[note-' || CAST(id AS STRING) || ']] ' || replace(substr(content, 1, 70), chr(10), ' ') END AS line FROM {src}"""
_SECTIONS = f"""il AS ({_INDEX}), sl AS (SELECT *, last_value(CASE WHEN line LIKE '## %' THEN substr(line, 4) END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM il)"""


@query("index_entries", f"WITH {_SECTIONS} SELECT doc, pos, section FROM sl WHERE line LIKE '- [[%'")
def _(s):
    """Entries of index notes with the section they stand in."""
    return lifecycle.sections(s.sql(_INDEX)).where(F.startswith("line", F.lit("- [["))).select("doc", "pos", "section")


@query("section_stats", f"WITH {_SECTIONS} SELECT section, count(*) AS n_lines, sum(strlen(line) + 1)::BIGINT AS bytes FROM sl GROUP BY section")
def _(s):
    return lifecycle.sections(s.sql(_INDEX)).groupBy("section").agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("line") + 1).alias("bytes"))


@query("index_stats", f"""WITH {_SECTIONS}, ss AS (SELECT doc, section, count(*) AS n, sum(strlen(line) + 1)::BIGINT AS b FROM sl GROUP BY doc, section)
  SELECT doc, sum(n)::BIGINT AS n_lines, sum(b)::BIGINT AS bytes, count(section) AS n_sections, count(*) FILTER (WHERE section IS NOT NULL AND b > 300) AS over_budget, sum(b) > 2000 AS over FROM ss GROUP BY doc""")
def _(s):
    """Size of each index note against its budget, and of its sections against theirs."""
    return lifecycle.index_stats(s.sql(_INDEX), budget=2000, section_budget=300)


# --- streams ------------------------------------------------------------------------------------------------------------------------------------


@query("event_sessions", """SELECT user_id, min(ts) AS started, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k
  FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM {events}) g) x GROUP BY user_id, k""")
def _(s):
    """Session windows: a user's events with less than half an hour between them."""
    from ..streaming import sessions

    return sessions.session_windows(s.events, "30 minutes").select("user_id", "started", "n")


@query("growth_stream", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n FROM {events} GROUP BY 1")
def _(s):
    """Daily counts by a stream over what is there."""
    from ..streaming import sessions

    stream = sessions.file_stream(s.spark, s.sf_dir, "events.parquet", s.events.schema)
    return sessions.run(sessions.daily_growth(stream), "complete").select("day", "n")


_FOLD = f"""WITH RECURSIVE ev AS (SELECT user_id AS stem, {_SEC('ts')} AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {{events}}),
  f AS (SELECT DISTINCT stem, 0::BIGINT AS n, 1.0::DOUBLE AS rs, 0.0::DOUBLE AS ss, {_SEC("TIMESTAMP '2024-01-01'")} AS t FROM ev
    UNION ALL SELECT f.stem, ev.n, least(1.0::DOUBLE, d.rs + 0.15::DOUBLE * (1 + ln(1 + d.ss))), d.ss, greatest(f.t, ev.t) FROM f JOIN ev ON ev.stem = f.stem AND ev.n = f.n + 1,
      LATERAL (SELECT f.rs * CASE WHEN ev.t > f.t THEN pow(0.5::DOUBLE, (ev.t - f.t) / 604800.0::DOUBLE / (1 + f.ss)) ELSE 1 END AS r) a, LATERAL (SELECT a.r AS rs, least(3.0::DOUBLE, f.ss + 0.1::DOUBLE * (1 - a.r)) AS ss) d)
  SELECT stem, n AS cnt, round(rs, 3) AS rs, round(ss, 3) AS ss FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY n DESC) AS k FROM f) x WHERE k = 1"""


@query("forget_stream", _FOLD)
def _(s):
    """The forgetting fold as state of a stream, over what is there."""
    from ..streaming import sessions

    stream = sessions.file_stream(s.spark, s.sf_dir, "events.parquet", s.events.schema).select(F.col("user_id").alias("stem"), "ts")
    found = sessions.run(sessions.forget_stream(stream, "2024-01-01"), "update")
    last = found.withColumn("k", F.row_number().over(Window.partitionBy("stem").orderBy(F.desc("cnt")))).where("k = 1")
    return last.select("stem", "cnt", F.round("rs", 3).alias("rs"), F.round("ss", 3).alias("ss"))


_GAP, _LATE = 3600, 60


@query("watch_sync", f"""WITH e AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM {{fileev}}), f AS (SELECT *, lead(ms) OVER w - ms AS gap FROM e WINDOW w AS (PARTITION BY path ORDER BY ms, n)),
  b AS (SELECT *, lag(hash) OVER (PARTITION BY path ORDER BY ms, n) AS known FROM f WHERE (gap IS NULL OR gap > {_GAP * 1000}) AND ms + {_GAP * 1000} < (SELECT max(ms) - {_LATE} * 60000 FROM e))
  SELECT path, make_timestamp(ms * 1000) AS at, CASE WHEN hash IS NULL THEN 'prune' WHEN known IS NULL THEN 'create' ELSE 'update' END AS action, hash FROM b WHERE hash IS DISTINCT FROM known""")
def _(s):
    """What a watcher does about events of files: a stream with settle timers over what is there, fed a month at a time."""
    from ..streaming import sessions, watch

    events = materialise(s.fileev.select("path", F.col("ts").cast("timestamp").alias("ts"), "n", "hash"), "file-events")
    folder, state, out = shared_path(s.spark, "file-events"), shared_path(s.spark, "watch-state"), None
    months = sorted(r[0] for r in events.select(F.month("ts")).distinct().collect())
    with watch.state_store(s.spark):
        for month in months:
            events.where(F.month("ts") == month).write.mode("append").parquet(folder)
            stream = sessions.file_stream(s.spark, folder, "*.parquet", events.schema)
            found = sessions.run(watch.watch(stream, _GAP, f"{_LATE} minutes"), "append", state)
            out = found if out is None else out.unionByName(found)
    return out.select("path", F.col("at").cast("timestamp_ntz").alias("at"), "action", "hash")
