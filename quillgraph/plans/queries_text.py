"""Text, retrieval, composition and similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import vectors as V
from ..operators import bags, contradict, filters, graph, notes, rerank, retrieval, similarity, textindex, udfs
from ..operators.components import connected_components
from ..schema import STOP
from ..shared import materialise
from .queries_graph import CONDUCTS, NEAR, POOL
from .views import Store

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- SQL building blocks ---------------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in sorted(STOP))


def toks(c: str) -> str:
    return f"list_transform(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: w NOT IN ({_STOP})), lambda w: substr(w, 1, 6))"


def prose(c: str) -> str:
    t = f"regexp_replace(regexp_replace(regexp_replace({c}, '\\r\\n?', chr(10), 'g'), '\\A[ \\t]*---[ \\t]*\\n(?s:.*?)(?m:^[ \\t]*---[ \\t]*$|\\z)', ''), '(?ms)^[ \\t]*```.*?(?:^[ \\t]*```[^\\n]*$|\\z)', '', 'g')"
    lines = f"list_transform(list_filter(string_split({t}, chr(10)), lambda x: NOT starts_with(x, '    ')), lambda x: trim(x))"
    return f"list_filter({lines}, lambda x: x <> '' AND NOT regexp_matches(x, '^(?:#|\\||---|>|\\*\\*|!\\[|\\[!|- \\[[ xX]\\])'))"


def strip(c: str) -> str:
    return f"replace(replace(regexp_replace({c}, '\\[([^\\]]+)\\]\\([^)]*\\)', '\\1', 'g'), '**', ''), '`', '')"


def sents(c: str) -> str:
    parts = f"flatten(list_transform({prose(c)}, lambda y: string_split(regexp_replace(regexp_replace({strip('y')}, '^[-*]\\s+', ''), '([.?!])\\s+', '\\1' || chr(1), 'g'), chr(1))))"
    return f"list_transform(list_filter(list_transform({parts}, lambda z: regexp_replace(trim(z), '[.:?!]+$', '')), lambda z: length(z) >= 30), lambda z: z || '.')"


QUERY_TERMS = f"qt AS (SELECT DISTINCT item_id AS qid, unnest({toks('text')}[1:8]) AS term FROM {{benchmark}})"
INDEX = "ix AS MATERIALIZED (SELECT id, content FROM {src} WHERE tombstoned = 0 AND redacted = 0 AND archived = 0)"
BM25 = f"""{INDEX}, tk AS MATERIALIZED (SELECT id, {toks('content')} AS t FROM ix), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tk),
  post AS MATERIALIZED (SELECT id, term, dl, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM tk) x WHERE term IN (SELECT term FROM qt) GROUP BY id, term, dl),
  dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
  parts AS (SELECT qt.qid, p.id, qt.term, ln((st.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE) + 1) * (p.tf * 2.2::DOUBLE) / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.dl / st.avgdl)) AS part
    FROM qt JOIN post p ON p.term = qt.term JOIN dfs d ON d.term = qt.term CROSS JOIN st),
  bm AS (SELECT qid, id, round(sum(part), 6) AS score FROM parts GROUP BY qid, id)"""
PIDS = f"pool AS (SELECT id FROM {{src}} WHERE {POOL})"


def queries_of(s: Store):
    """One query for each benchmark item: its first eight words."""
    return s.benchmark.select(F.col("item_id").alias("qid"), F.array_join(F.slice(T.tokens(F.col("text")), 1, 8), " ").alias("text"))


def index_of(s: Store):
    return filters.indexed(s.src).select("id", "content")


def lexical(s: Store, queries) -> retrieval.Built:
    """What the session's text index over these tables holds for the queries; the index is made on first use and stays."""
    index = textindex.kept(s.spark, f"sources of {s.sf_dir}", [f"{s.sf_dir}/{t}.parquet" for t in ("documents", "labels")], lambda: index_of(s))
    return index.lookup(queries)


def pool_of(s: Store):
    return s.src.where(filters.untainted()).select("id")


# --- text ----------------------------------------------------------------------------------------------------------------


@query("text_tokens", f"SELECT id, len({toks('content')}) AS n_tokens, sha256(array_to_string({toks('content')}, ' ')) AS digest FROM {{src}}")
def _(s):
    t = T.tokens(F.col("content"))
    return s.src.select("id", F.size(t).cast("long").alias("n_tokens"), F.sha2(F.array_join(t, " "), 256).alias("digest"))


@query("text_snippets", f"SELECT id, substr(trim(regexp_replace({strip('coalesce(' + prose('content') + '[1], content)')}, '\\s+', ' ', 'g')), 1, 70) AS snippet FROM {{nodes}}")
def _(s):
    return s.nodes.select("id", T.snippet(F.col("content")).alias("snippet"))


@query("prose_lines", f"SELECT id, len({prose('content')}) AS n, sha256(array_to_string({prose('content')}, chr(10))) AS digest FROM {{src}}")
def _(s):
    p = T.prose_lines(F.col("content"))
    return s.src.select("id", F.size(p).cast("long").alias("n"), F.sha2(F.array_join(p, "\n"), 256).alias("digest"))


@query("candidate_sentences", f"SELECT id, unnest({sents('content')}) AS sentence FROM {{src}}")
def _(s):
    return s.src.select("id", F.explode(T.sentences(F.col("content"))).alias("sentence"))


@query("content_hash", "SELECT id, sha256(trim(regexp_replace(content, '\\s+', ' ', 'g'))) AS h FROM {src}")
def _(s):
    return s.src.select("id", T.content_hash(F.col("content")).alias("h"))


_QUAD = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_KV = r"(?m)^[ \t]*([A-Za-z_][A-Za-z0-9_.-]*)[ \t]*=[ \t]*([^ \t\n]+)[ \t]*$"
_CLAIM = rf"""WITH c AS (SELECT id, regexp_extract(content, '(?:^|[^\pL\pN_])([0-9a-fA-F]{{64}})(?:$|[^\pL\pN_])', 1) AS sha, regexp_extract(content, '(?:^|[^\pL\pN_])((?:{_QUAD}\.){{3}}{_QUAD})(?:$|[^\pL\pN_])', 1) AS ip,
  regexp_extract(content, '(?i)(?:^|[^\pL\pN_])port\s+([0-9]{{1,5}})(?:$|[^\pL\pN_])', 1) AS port, regexp_extract(content, '(?:^|[^\pL\pN_])([0-9]+\.[0-9]+\.[0-9]+)(?:$|[^\pL\pN_])', 1) AS ver, regexp_extract(content, '{_KV}', 1) AS k, regexp_extract(content, '{_KV}', 2) AS v FROM {{src}}),
  f AS (SELECT *, port <> '' AND coalesce(try_cast(port AS INTEGER), 0) BETWEEN 1 AND 65535 AS okp FROM c)
  SELECT id, CASE WHEN sha <> '' THEN 'sha256' WHEN ip <> '' THEN 'ipv4' WHEN okp THEN 'port' WHEN ver <> '' THEN 'version' ELSE k END AS subject,
    CASE WHEN sha <> '' OR ip <> '' OR okp OR ver <> '' THEN 'is' ELSE '=' END AS predicate,
    CASE WHEN sha <> '' THEN lower(sha) WHEN ip <> '' THEN ip WHEN okp THEN port WHEN ver <> '' THEN ver ELSE v END AS value FROM f WHERE sha <> '' OR ip <> '' OR okp OR ver <> '' OR k <> ''"""


@query("claim_extract", _CLAIM)
def _(s):
    return s.src.select("id", T.extract_claim(F.col("content")).alias("c")).where("c is not null").select("id", "c.subject", "c.predicate", "c.value")


@query("text_chunks")
def _(s):
    """Chunks of at most 1200 characters at paragraph, line, sentence or word ends, with their hashes."""
    return s.src.select("id", F.posexplode(udfs.chunks(F.col("content"))).alias("n", "chunk")).select("id", "n", F.length("chunk").alias("length"), T.content_hash(F.col("chunk")).alias("h"))


_MDLINES = """ln AS MATERIALIZED (SELECT id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS k FROM {mdnotes}),
  fm AS MATERIALIZED (SELECT id, min(k) AS z FROM ln WHERE k > 1 AND trim(line) = '---' GROUP BY id)"""


@query("wikilinks", f"""WITH RECURSIVE {_MDLINES}, body AS MATERIALIZED (SELECT ln.id, k - z AS k, line, regexp_extract(line, '^\\s*(````*|~~~~*)', 1) AS mark FROM ln JOIN fm ON ln.id = fm.id WHERE k > z),
  st AS (SELECT id, 1 AS k, mark AS fence, line, mark = '' AS shown FROM body WHERE k = 1
    UNION ALL SELECT b.id, b.k, CASE WHEN st.fence <> '' AND starts_with(b.mark, st.fence) THEN '' WHEN st.fence <> '' THEN st.fence ELSE b.mark END, b.line, st.fence = '' AND b.mark = '' FROM st JOIN body b ON b.id = st.id AND b.k = st.k + 1),
  plain AS (SELECT id, regexp_replace(regexp_replace(line, '``([^`]|`[^`])*``', ' ', 'g'), '`[^`]*`', ' ', 'g') AS line FROM st WHERE shown AND NOT starts_with(line, '    '))
  SELECT id, regexp_replace(regexp_extract(inner_, '^[^|#]*'), '\\.md$', '') AS target, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(line, '\\[\\[([^\\[\\]]+)\\]\\]', 1)) AS inner_ FROM plain) x GROUP BY 1, 2""")
def _(s):
    """Targets of links outside fences, indented code and code spans."""
    return notes.links(s.mdnotes).where("kind = 'wiki'").groupBy("id", "target").agg(F.count("*").alias("n"))


@query("frontmatter", f"""WITH {_MDLINES}, own AS (SELECT ln.* FROM ln JOIN fm ON ln.id = fm.id WHERE k > 1 AND k < z), kv AS (SELECT *, NOT regexp_matches(line, '^\\s*- ') AS is_key FROM own),
  named AS (SELECT *, max(CASE WHEN is_key THEN k END) OVER (PARTITION BY id ORDER BY k) AS grp FROM kv),
  bare AS (SELECT id, k, grp, is_key, line, regexp_replace(trim(CASE WHEN is_key THEN regexp_replace(line, '^[^:]*:', '') ELSE regexp_replace(line, '^\\s*- ', '') END), '^"(.*)"$', '\\1') AS v FROM named),
  g AS (SELECT id, grp, regexp_extract(max(CASE WHEN is_key THEN line END), '^[^:]*') AS key, count(*) AS n, max(CASE WHEN is_key THEN v END) AS v, string_agg(CASE WHEN NOT is_key THEN v END, '|' ORDER BY k) AS listed FROM bare GROUP BY id, grp)
  SELECT id, key, CASE WHEN n = 1 AND NOT starts_with(v, '[') THEN v END AS value, CASE WHEN n > 1 THEN listed WHEN starts_with(v, '[') THEN
    array_to_string(list_filter(list_transform(string_split(trim(v, '[]'), ','), lambda y: trim(trim(y), '''')), lambda y: y <> ''), '|') END AS items FROM g""")
def _(s):
    """Scalars, inline lists and block lists of the front matter."""
    return notes.fields(s.mdnotes).select("id", "key", "value", F.array_join("items", "|").alias("items"))


@query("code_chunks", "SELECT id, (pos - 1) // 60 AS chunk, count(*) AS n_lines, sum(length(line))::BIGINT AS chars FROM (SELECT id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS pos FROM {src}) x GROUP BY 1, 2")
def _(s):
    """Windows of 60 lines."""
    lines = F.split("content", "\n")
    return s.src.select("id", F.posexplode(lines).alias("n", "line")).groupBy("id", F.floor(F.col("n") / 60).alias("chunk")).agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("chars"))


# --- retrieval -----------------------------------------------------------------------------------------------------------


@query("corpus_stats", f"WITH {INDEX} SELECT count(*) AS n, round(avg(len({toks('content')})), 6) AS avgdl FROM ix")
def _(s):
    return lexical(s, queries_of(s)).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


@query("term_freq", f"WITH {INDEX} SELECT term, count(DISTINCT id) AS df, count(*) AS tf FROM (SELECT id, unnest({toks('content')}) AS term FROM ix) x GROUP BY term")
def _(s):
    """Document and corpus frequency of every term; counts of a document come first, so the shuffle carries partial sums."""
    words = index_of(s).select("id", F.explode(T.tokens(F.col("content"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("n"))
    return words.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("tf"))


@query("bm25_topk", f"WITH {QUERY_TERMS}, {BM25} SELECT qid, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM bm) x WHERE r <= 10")
def _(s):
    return retrieval.ranked(retrieval.bm25(lexical(s, queries_of(s)), queries_of(s)), 10).select("qid", "id", "score")


@query("bm25_scoped", f"""WITH {QUERY_TERMS}, {BM25} SELECT qid, id, score FROM (SELECT bm.*, row_number() OVER (PARTITION BY qid ORDER BY score DESC, bm.id) AS r FROM bm JOIN {{src}} s ON s.id = bm.id WHERE s.source_ref = 'src5') x WHERE r <= 10""")
def _(s):
    """One source only; the statistics stay those of the whole index."""
    scope = s.src.where("source_ref = 'src5'").select("id")
    return retrieval.ranked(retrieval.bm25(lexical(s, queries_of(s)), queries_of(s)).join(scope, "id", "left_semi"), 10).select("qid", "id", "score")


_SCORED = "SELECT qid, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM bm) x WHERE r <= 10"


def _index_of_before(s: Store):
    """The store as it was: every tenth source is missing, the next of ten had another text, and there were some that are gone now."""
    now = index_of(s)
    kind = F.col("id") % 10
    before = now.where(kind != 1).select("id", F.when(kind == 2, F.concat(F.lit("an older text about retrieval "), F.upper(F.substring("content", 1, 200)))).otherwise(F.col("content")).alias("content"))
    return before.unionByName(now.where(kind == 3).select((F.col("id") + 50_000_000).alias("id"), "content"))


@query("index_refresh", f"WITH {QUERY_TERMS}, {BM25} {_SCORED}")
def _(s):
    """An index of an earlier state of the store, brought up to date by what was added, changed and removed since: it answers as
    one that is built anew."""
    index = textindex.TextIndex.create(s.spark, _index_of_before(s))
    index.refresh(index_of(s))
    return retrieval.ranked(retrieval.bm25(index.lookup(queries_of(s)), queries_of(s)), 10).select("qid", "id", "score")


@query("index_drop", f"WITH {QUERY_TERMS}, {BM25.replace('archived = 0)', 'archived = 0 AND id % 7 <> 0)')} {_SCORED}")
def _(s):
    """De-indexed sources are found no more and count in no statistic; a compacted index says the same."""
    index = textindex.TextIndex.create(s.spark, index_of(s))
    index.drop(s.src.where("id % 7 = 0").select("id"))
    index.compact()
    return retrieval.ranked(retrieval.bm25(index.lookup(queries_of(s)), queries_of(s)), 10).select("qid", "id", "score")


@query("coverage", f"""WITH {QUERY_TERMS}, {BM25}, ceil_ AS (SELECT qid, sum(ln((st.n - coalesce(d.df, 0) + 0.5::DOUBLE) / (coalesce(d.df, 0) + 0.5::DOUBLE) + 1) * 2.2::DOUBLE) AS top FROM qt LEFT JOIN dfs d ON d.term = qt.term CROSS JOIN st GROUP BY qid)
  SELECT p.qid, p.id, round(least(1, sum(p.part) / min(c.top)), 6) AS coverage FROM parts p JOIN ceil_ c ON c.qid = p.qid GROUP BY p.qid, p.id""")
def _(s):
    return retrieval.coverage(lexical(s, queries_of(s)), queries_of(s))


COSINE = "round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"


@query("vector_search", f"""SELECT qid, id, score FROM (SELECT q.vec_id AS qid, v.vec_id AS id, {COSINE} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE} DESC, v.vec_id) AS r
  FROM {{embeddings}} v CROSS JOIN (SELECT * FROM {{embeddings}} WHERE vec_id % 50 = 0) q) x WHERE r <= 10""")
def _(s):
    """The stated query set, every vector whose id is divisible by 50, against all vectors."""
    vectors = s.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return retrieval.ranked(retrieval.dense(vectors, vectors.where("id % 50 = 0").withColumnRenamed("id", "qid"), 10), 10).select("qid", "id", "score")


SPARSE = f"""qw AS (SELECT qid, term, count(*) AS w FROM (SELECT item_id AS qid, unnest({toks('text')}[1:8]) AS term FROM {{benchmark}}) y GROUP BY qid, term),
  sp AS (SELECT qw.qid, p.id, sum(p.tf * qw.w)::DOUBLE AS score FROM qw JOIN post p ON p.term = qw.term GROUP BY qw.qid, p.id)"""


@query("sparse_search", f"WITH {QUERY_TERMS}, {BM25}, {SPARSE} SELECT qid, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM sp) x WHERE r <= 10")
def _(s):
    return retrieval.ranked(retrieval.sparse(lexical(s, queries_of(s)), queries_of(s)), 10).select("qid", "id", "score")


HYBRID = f"""{QUERY_TERMS}, {BM25}, {SPARSE}, {PIDS},
  qv AS (SELECT b.item_id AS qid, e.embedding FROM {{benchmark}} b JOIN {{embeddings}} e ON e.vec_id = b.item_id), de AS (SELECT q.qid, v.vec_id AS id, {COSINE} AS score FROM {{embeddings}} v CROSS JOIN qv q),
  l1 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM bm WHERE id IN (SELECT id FROM pool)),
  l2 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM de WHERE id IN (SELECT id FROM pool)),
  l3 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM sp WHERE id IN (SELECT id FROM pool)),
  fused AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS score FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) x WHERE r <= 50 GROUP BY qid, id),
  top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM fused)"""


def hybrid(s: Store):
    vectors = s.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    qv = queries_of(s).select("qid").join(vectors, F.col("qid") == F.col("id")).select("qid", "vec")
    return retrieval.retrieve(lexical(s, queries_of(s)), pool_of(s), vectors, queries_of(s), qv)


@query("rrf_fuse", f"WITH {HYBRID} SELECT qid, id, score FROM fused")
def _(s):
    return hybrid(s).select("qid", "id", "score")


@query("retrieve_hybrid", f"WITH {HYBRID} SELECT qid, id, score FROM top WHERE r <= 8")
def _(s):
    return retrieval.ranked(hybrid(s), 8).select("qid", "id", "score")


@query("colbert_rerank", f"""WITH {HYBRID}, mat AS (SELECT vec_id AS id, [embedding[1:16], embedding[17:32], embedding[33:48], embedding[49:64]] AS m FROM {{embeddings}}),
  sc AS (SELECT t.qid, t.id, t.r, round(list_sum(list_transform(q.m, lambda x: list_max(list_transform(d.m, lambda y: list_dot_product(x::DOUBLE[], y::DOUBLE[]))))), 6) AS ms
    FROM top t LEFT JOIN mat q ON q.id = t.qid LEFT JOIN mat d ON d.id = t.id AND t.r <= 20 WHERE t.r <= 50)
  SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN ms IS NULL THEN 1 ELSE 0 END, ms DESC, r) AS rank FROM sc""")
def _(s):
    """Late interaction over the fused window: the best document token of each query token, summed; without tokens the
    fused order stays, behind, as it does for the tail beyond the window."""
    mat = s.embeddings.select(F.col("vec_id").alias("mid"), F.array(*(F.slice("embedding", 16 * k + 1, 16) for k in range(4))).alias("m"))
    window = retrieval.ranked(hybrid(s), 50)
    both = window.join(mat.select(F.col("mid").alias("qid"), F.col("m").alias("qm")), "qid", "left").join(mat.select(F.col("mid").alias("id"), F.col("m").alias("dm")), "id", "left")
    scored = both.withColumn("ms", F.when((F.col("rank") <= 20) & F.col("dm").isNotNull() & F.col("qm").isNotNull(), F.round(V.maxsim(F.col("qm"), F.col("dm")), 6)))
    order = Window.partitionBy("qid").orderBy(F.col("ms").isNull(), F.desc("ms"), "rank")
    return scored.select("qid", "id", F.row_number().over(order).cast("long").alias("rank"))


@query("fusion_variants", f"WITH {HYBRID} SELECT qid, id, round(sum(w / (60 + r)), 6) AS score FROM (SELECT *, 2.0::DOUBLE AS w FROM l1 UNION ALL SELECT *, 1.0::DOUBLE FROM l2) x WHERE r <= 50 GROUP BY qid, id")
def _(s):
    vectors = s.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    qv = queries_of(s).select("qid").join(vectors, F.col("qid") == F.col("id")).select("qid", "vec")
    inside = lambda x: retrieval.ranked(x.join(pool_of(s), "id", "left_semi"), 50)
    return retrieval.rrf(inside(retrieval.bm25(lexical(s, queries_of(s)), queries_of(s))), inside(retrieval.dense(vectors, qv)), weights=(2.0, 1.0))


@query("retrieve_graph", f"""WITH RECURSIVE {HYBRID}, {NEAR[len('WITH RECURSIVE '):].replace("WHERE s.channel = 'endorsed'", "")},
  boost AS (SELECT t.qid, h.id, sum(t.score * CASE h.hop WHEN 1 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END) AS b FROM top t JOIN hood h ON h.seed = t.id WHERE t.r <= 8 GROUP BY t.qid, h.id),
  re AS (SELECT f.qid, f.id, round(f.score + coalesce(b.b, 0), 6) AS score FROM fused f LEFT JOIN boost b ON b.qid = f.qid AND b.id = f.id)
  SELECT qid, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM re) x WHERE r <= 8""")
def _(s):
    """Seeds lift their neighbours by half their score for each hop; only what was retrieved can move."""
    fused = materialise(hybrid(s), "fused")
    seeds = retrieval.ranked(fused, 8).select("qid", F.col("id").alias("seed"), F.col("score").alias("from_score"))
    nodes = s.src.select("id", "label", F.expr(CONDUCTS).alias("conducts"))
    hood = graph.neighborhood(nodes, s.rel, seeds.select(F.col("seed").alias("id")).distinct(), 2)
    boost = seeds.join(hood, "seed").groupBy("qid", "id").agg(F.sum(F.col("from_score") * F.pow(F.lit(0.5), F.col("hop"))).alias("b"))
    again = fused.join(boost, ["qid", "id"], "left").select("qid", "id", F.round(F.col("score") + F.coalesce("b", F.lit(0.0)), 6).alias("score"))
    return retrieval.ranked(again, 8).select("qid", "id", "score")


@query("ir_metrics", f"""WITH {HYBRID}, m AS (SELECT qid, min(CASE WHEN s.source_ref = 'src' || (qid % 20) THEN t.r END) AS first_hit, sum(CASE WHEN s.source_ref = 'src' || (qid % 20) THEN 1 ELSE 0 END) AS hits FROM top t JOIN {{src}} s ON s.id = t.id WHERE t.r <= 8 GROUP BY qid)
  SELECT count(*) AS n, round(avg(CASE WHEN first_hit = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit1, round(avg(CASE WHEN first_hit <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit5, round(avg(coalesce(1.0::DOUBLE / first_hit, 0)), 6) AS mrr, sum(hits) AS hits,
    round(avg(hits::DOUBLE / g.n), 6) AS recall8 FROM m JOIN (SELECT source_ref, count(*) AS n FROM {{src}} WHERE {POOL} GROUP BY source_ref) g ON g.source_ref = 'src' || (m.qid % 20)""")
def _(s):
    """hit@1, hit@5, MRR and recall@8; gold is any document of the query's source in the pool."""
    top = retrieval.ranked(hybrid(s), 8).join(s.src.select("id", "source_ref"), "id")
    good = F.col("source_ref") == F.concat(F.lit("src"), (F.col("qid") % 20).cast("string"))
    m = top.groupBy("qid").agg(F.min(F.when(good, F.col("rank"))).alias("first_hit"), F.sum(F.when(good, 1).otherwise(0)).alias("hits"))
    gold = s.src.where(filters.untainted()).groupBy("source_ref").agg(F.count("*").alias("gold"))
    m = m.join(gold, F.col("source_ref") == F.concat(F.lit("src"), (F.col("qid") % 20).cast("string")))
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return m.agg(F.count("*").alias("n"), rate(F.col("first_hit") == 1).alias("hit1"), rate(F.col("first_hit") <= 5).alias("hit5"), F.round(F.avg(F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0))), 6).alias("mrr"), F.sum("hits").alias("hits"), F.round(F.avg(F.col("hits") / F.col("gold")), 6).alias("recall8"))


def signals(s: Store):
    """The ranked lists that are fused, each inside the pool."""
    vectors = s.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    q, pool = queries_of(s), materialise(pool_of(s), "pool")
    built = lexical(s, q)
    qv = q.select("qid").join(vectors, F.col("qid") == F.col("id")).select("qid", "vec")
    inside = lambda x: retrieval.ranked(x.join(pool, "id", "left_semi"), 50)
    return {"bm25": inside(retrieval.bm25(built, q)), "dense": inside(retrieval.dense(vectors, qv)), "sparse": inside(retrieval.sparse(built, q))}


_FEATS = ", ".join(f"round(coalesce(max(CASE WHEN sig = '{name}' THEN z END), 0), 4) + 0.0 AS {name}_z, round(coalesce(max(CASE WHEN sig = '{name}' THEN 1.0::DOUBLE / r END), 0), 6) AS {name}_rr" for name in ("bm25", "dense", "sparse"))


@query("signal_features", f"""WITH {HYBRID}, al AS (SELECT 'bm25' AS sig, * FROM l1 WHERE r <= 50 UNION ALL SELECT 'dense', * FROM l2 WHERE r <= 50 UNION ALL SELECT 'sparse', * FROM l3 WHERE r <= 50),
  zs AS (SELECT *, (score - avg(score) OVER w) / nullif(stddev_pop(score) OVER w, 0) AS z FROM al WINDOW w AS (PARTITION BY sig, qid)) SELECT qid, id, {_FEATS} FROM zs GROUP BY qid, id""")
def _(s):
    """z-scores and reciprocal ranks of every signal for every candidate."""
    feats = rerank.features(signals(s))
    return feats.select("qid", "id", *((F.round(c, 4 if c.endswith("_z") else 6) + 0.0).alias(c) for c in feats.columns[2:]))


@query("learned_rerank")
def _(s):
    """Candidates of the held-out half of the queries, ranked by what the other half teaches; gold is any document of the query's
    source. Fitted by iteration, so there is no SQL; tested against a plain fit."""
    feats = rerank.features(signals(s))
    source = s.src.select("id", F.regexp_extract("source_ref", r"(\d+)$", 1).cast("long").alias("n"))
    gold = feats.select("qid", "id").join(source, "id").where(F.col("qid") % 20 == F.col("n"))
    return rerank.rerank(feats, gold)


@query("rank_features", f"WITH {HYBRID} SELECT f.qid, f.id, round((score - avg(score) OVER w) / nullif(stddev_pop(score) OVER w, 0), 4) AS z, round(1.0::DOUBLE / rank() OVER (PARTITION BY qid ORDER BY score DESC), 6) AS rr FROM fused f WINDOW w AS (PARTITION BY qid)")
def _(s):
    w = Window.partitionBy("qid")
    z = (F.col("score") - F.avg("score").over(w)) / F.nullif(F.stddev_pop("score").over(w), F.lit(0.0))
    return hybrid(s).select("qid", "id", F.round(z, 4).alias("z"), F.round(1.0 / F.rank().over(w.orderBy(F.desc("score"))), 6).alias("rr"))


# --- composition -----------------------------------------------------------------------------------------------------------

FIRST = "regexp_replace(substr(list_filter(list_transform(string_split(content, chr(10)), lambda f: trim(f)), lambda f: f <> '')[1], 1, 200), '[.:]+$', '') || '.'"
CANDS = f"CASE WHEN len({sents('content')}) > 0 THEN {sents('content')} WHEN {FIRST} IS NOT NULL THEN [{FIRST}] ELSE []::VARCHAR[] END"


@query("compose", f"""WITH {QUERY_TERMS}, {BM25}, {PIDS}, t8 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM bm WHERE id IN (SELECT id FROM pool)) x WHERE r <= 8),
  cs AS (SELECT t.qid, t.r, n.id, n.channel, unnest({CANDS}) AS sent, generate_subscripts({CANDS}, 1) AS pos FROM t8 t JOIN {{src}} n ON n.id = t.id),
  sc AS (SELECT cs.*, EXISTS (SELECT 1 FROM qt WHERE qt.qid = cs.qid AND contains(lower(cs.sent), qt.term)) AS hit FROM cs),
  pk AS (SELECT * FROM (SELECT sc.*, max(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY qid, id) AS some_hit FROM sc) y WHERE hit OR (some_hit = 0 AND pos = 1))
  SELECT qid, count(DISTINCT id) AS n_sources, string_agg('- ' || sent || ' [mem:' || id || '|' || channel || ']', chr(10) ORDER BY r, pos) AS answer FROM pk GROUP BY qid""")
def _(s):
    """Extractive answers over the best sources in rank order: every sentence that holds a query stem as a substring, else the
    first, with a citation each."""
    q = queries_of(s)
    keys = q.select("qid", F.array_distinct(T.tokens(F.col("text"))).alias("keys"))
    inside = retrieval.bm25(lexical(s, q), q).join(pool_of(s), "id", "left_semi")
    top = retrieval.ranked(inside, 8).join(s.src.select("id", "channel", "content"), "id").join(keys, "qid")
    cands = top.withColumn("cands", T.claims_of(F.col("content")))
    hits = F.filter("cands", lambda c: F.exists("keys", lambda k: F.contains(F.lower(c), k)))
    picked = cands.withColumn("picked", F.when(F.size(hits) > 0, hits).otherwise(F.slice("cands", 1, 1))).where(F.size("picked") > 0)
    bullets = F.transform("picked", lambda c: F.concat(F.lit("- "), c, F.lit(" [mem:"), F.col("id").cast("string"), F.lit("|"), F.col("channel"), F.lit("]")))
    parts = picked.select("qid", F.struct("rank", F.array_join(bullets, "\n").alias("t")).alias("p"))
    return parts.groupBy("qid").agg(F.count("*").alias("n_sources"), F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), "\n").alias("answer"))


_LINES = ORACLES["compose"].split("\n  SELECT qid, count(DISTINCT id)")[0]


@query("citation_check", f"""{_LINES}, ln AS (SELECT qid, CASE WHEN id % 11 = 0 THEN id + 500000000 ELSE id END AS id, CASE WHEN id % 7 = 0 THEN 'endorsed' ELSE channel END AS cited, list_distinct({toks("sent")}) AS own FROM pk)
  SELECT l.qid, l.id, coalesce(n.channel = l.cited AND len(list_intersect(l.own, list_distinct({toks("n.content")}))) / greatest(len(l.own), 1)::DOUBLE >= 0.2, FALSE) AS ok FROM ln l LEFT JOIN {{src}} n ON n.id = l.id""")
def _(s):
    """The citation firewall over composed answers, some of them forged: every cited node exists, has the cited channel, and
    shares at least a fifth of the line's stems."""
    lines = QUERIES["compose"](s).select("qid", F.explode(F.split("answer", "\n")).alias("line"))
    pattern = r"\[mem:(\d+)\|([a-z-]+)\]$"
    cited = lines.select("qid", "line", F.regexp_extract("line", pattern, 1).cast("long").alias("id"), F.regexp_extract("line", pattern, 2).alias("cited"))
    cited = cited.withColumn("cited", F.when(F.col("id") % 7 == 0, "endorsed").otherwise(F.col("cited"))).withColumn("id", F.when(F.col("id") % 11 == 0, F.col("id") + 500_000_000).otherwise(F.col("id")))
    return contradict.firewall(cited, s.src.select("id", "channel", "content")).select("qid", "id", "ok")


# --- similarity ------------------------------------------------------------------------------------------------------------

SETS = f"ts AS MATERIALIZED (SELECT id, list_distinct({toks('content')}) AS t FROM {{der}} WHERE tombstoned = 0)"
POOLED = f"""tp AS MATERIALIZED (SELECT id, list_distinct({toks('content')}) AS t FROM {{src}} WHERE {POOL}), tw AS MATERIALIZED (SELECT id, len(t) AS n, unnest(t) AS w FROM tp),
  pq AS MATERIALIZED (SELECT a.id AS a, b.id AS b, round(count(*) * 1.0::DOUBLE / (a.n + b.n - count(*)), 6) AS jaccard FROM tw a JOIN tw b ON a.w = b.w AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n)"""
PAIRS = f"{SETS}, pr AS MATERIALIZED (SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.t, b.t)) * 1.0::DOUBLE / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard FROM ts a JOIN ts b ON a.id < b.id AND len(a.t) > 0 AND len(b.t) > 0)"


def pool_sets(s):
    return bags.bags(s.src.where(filters.untainted()).select("id", "content"))


def stem_sets(s):
    return bags.bags(s.der.where("tombstoned = 0").select("id", "content"))


@query("jaccard_pairs", f"WITH {POOLED} SELECT a, b, jaccard FROM pq WHERE jaccard >= 0.5")
def _(s):
    return similarity.jaccard_pairs(pool_sets(s), 0.5).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("similarity_groups", f"""WITH RECURSIVE {POOLED}, l AS (SELECT a AS u, b AS v FROM pq WHERE jaccard >= 0.5 UNION SELECT b, a FROM pq WHERE jaccard >= 0.5), r AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.v)
  SELECT u AS id, least(u, min(v)) AS grp FROM r GROUP BY u""")
def _(s):
    return connected_components(similarity.jaccard_links(pool_sets(s), 0.5)).select("id", F.col("component").alias("grp"))


@query("novelty", f"WITH {PAIRS}, bp AS (SELECT a AS id, jaccard FROM pr UNION ALL SELECT b, jaccard FROM pr) SELECT t.id, round(1 - coalesce(max(bp.jaccard), 0), 6) AS novelty FROM ts t LEFT JOIN bp ON bp.id = t.id GROUP BY t.id")
def _(s):
    """One less the best Jaccard similarity to any other derived node."""
    return similarity.best_jaccard(stem_sets(s)).select("id", F.round(1 - F.round("best", 6), 6).alias("novelty"))


@query("nearest_cluster", f"""WITH {QUERY_TERMS.split(' AS ')[0]} AS (SELECT DISTINCT id AS qid, unnest({toks('content')}) AS term FROM {{der}} WHERE tombstoned = 0), {BM25}
  SELECT qid, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM bm) x WHERE r = 1""")
def _(s):
    """For each derived node the source that its whole text, taken as a query, ranks first."""
    q = s.der.where("tombstoned = 0").select(F.col("id").alias("qid"), F.col("content").alias("text"))
    return similarity.best_bm25(index_of(s), q)


TFIDF = f"""d AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({toks('content')}) AS term FROM {{der}} WHERE tombstoned = 0) x GROUP BY id, term),
  nn AS (SELECT count(*) AS n FROM {{der}} WHERE tombstoned = 0), idf AS (SELECT term, ln((1 + nn.n) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM d CROSS JOIN nn GROUP BY term, nn.n),
  w AS MATERIALIZED (SELECT d.id, d.term, d.tf * idf.idf AS w FROM d JOIN idf ON idf.term = d.term), nr AS (SELECT id, sqrt(sum(w * w)) AS nr FROM w GROUP BY id),
  cs AS (SELECT a.id AS a, b.id AS b, sum(a.w * b.w) AS dot FROM w a JOIN w b ON a.term = b.term AND a.id <> b.id GROUP BY a.id, b.id),
  best AS (SELECT cs.a AS id, max(round(cs.dot / (x.nr * y.nr), 6)) AS top FROM cs JOIN nr x ON x.id = cs.a JOIN nr y ON y.id = cs.b GROUP BY cs.a)"""


@query("rank_similar", f"WITH {TFIDF} SELECT id, top FROM best")
def _(s):
    return similarity.best_tfidf(s.der.where("tombstoned = 0").select("id", "content"))


@query("surprise", f"WITH {TFIDF} SELECT n.id, round(greatest(0, least(1, 1 - coalesce(b.top, 0))), 6) AS surprise FROM {{der}} n LEFT JOIN best b ON b.id = n.id WHERE n.tombstoned = 0")
def _(s):
    nodes = s.der.where("tombstoned = 0").select("id", "content")
    top = similarity.best_tfidf(nodes)
    return nodes.select("id").join(top, "id", "left").select("id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce("top", F.lit(0.0)))), 6).alias("surprise"))


@query("surprise_gate", f"WITH {TFIDF} SELECT n.id, CASE WHEN 1 - coalesce(b.top, 0) < 0.35 THEN 'cite' ELSE 'derive' END AS action FROM {{der}} n LEFT JOIN best b ON b.id = n.id WHERE n.tombstoned = 0")
def _(s):
    return QUERIES["surprise"](s).select("id", F.when(F.col("surprise") < 0.35, "cite").otherwise("derive").alias("action"))


@query("extractive_summary", f"""WITH c AS (SELECT conv_id, id, unnest({CANDS}) AS sent, generate_subscripts({CANDS}, 1) AS pos FROM {{der}} WHERE tombstoned = 0),
  u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, trim(regexp_replace(lower(sent), '\\s+', ' ', 'g')) ORDER BY id, pos) AS rn FROM c) x WHERE rn = 1),
  cm AS (SELECT conv_id, term FROM (SELECT DISTINCT conv_id, id, unnest({toks('content')}) AS term FROM {{der}} WHERE tombstoned = 0) y GROUP BY conv_id, term HAVING count(*) >= 2),
  sc AS (SELECT u.conv_id, u.id, u.pos, u.sent, (SELECT count(*) FROM cm WHERE cm.conv_id = u.conv_id AND list_contains({toks('u.sent')}, cm.term)) AS score FROM u),
  pk AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, id, pos) AS r FROM sc)
  SELECT conv_id, string_agg('- ' || sent, chr(10) ORDER BY id, pos) AS summary FROM pk WHERE r <= 5 GROUP BY conv_id""")
def _(s):
    """Five sentences for each conversation's derived nodes: those with most stems that two of its nodes share."""
    nodes = s.der.where("tombstoned = 0").select("conv_id", "id", "content")
    sent = nodes.select("conv_id", "id", F.posexplode(T.claims_of(F.col("content"))).alias("pos", "sent"))
    first = Window.partitionBy("conv_id", F.trim(F.regexp_replace(F.lower("sent"), r"\s+", " "))).orderBy("id", "pos")
    sent = sent.withColumn("n", F.row_number().over(first)).where("n = 1")
    terms = nodes.select("conv_id", "id", F.explode(T.stems(F.col("content"))).alias("term"))
    common = terms.groupBy("conv_id", "term").agg(F.count("*").alias("n")).where("n >= 2").groupBy("conv_id").agg(F.collect_list("term").alias("common"))
    score = F.size(F.array_intersect(T.stems(F.col("sent")), F.coalesce("common", F.array().cast("array<string>"))))
    ranked = sent.drop("n").join(common, "conv_id", "left").withColumn("score", score)
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "id", "pos"))).where("r <= 5")
    parts = ranked.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("id", "pos", "sent"))).alias("p"))
    return parts.select("conv_id", F.array_join(F.transform("p", lambda p: F.concat(F.lit("- "), p["sent"])), "\n").alias("summary"))


_DIFF = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(lower(regexp_replace({c}, '`[^`]+`', ' ', 'g')), '[*_#>|()\[\],:;!?]', ' ', 'g'), '\s+'), lambda t: trim(t, '.')), lambda t: t <> '')"
_NO_CLAIM = ", ".join(f"'{w}'" for w in T.NO_CLAIM)


@query("contradict_pairs", rf"""WITH {POOLED}, st AS (SELECT id, {sents('content')} AS ss FROM {{src}}), x AS (SELECT pq.a, pq.b, unnest(sa.ss) AS x, sb.ss FROM pq JOIN st sa ON sa.id = pq.a JOIN st sb ON sb.id = pq.b WHERE pq.jaccard >= 0.5),
  y AS (SELECT a, b, x, unnest(ss) AS y FROM x), z AS (SELECT a, b, list_distinct({toks('x')}) AS sx, list_distinct({toks('y')}) AS sy, {_DIFF.format(c='x')} AS x, {_DIFF.format(c='y')} AS y FROM y WHERE x <> y),
  j AS (SELECT a, b, x, y, CASE WHEN len(sx) + len(sy) = 0 THEN 0 ELSE len(list_intersect(sx, sy)) / len(list_distinct(list_concat(sx, sy)))::DOUBLE END AS j FROM z),
  d AS (SELECT a, b, j, list_filter(list_distinct(list_concat(x, y)), lambda t: len(list_filter(x, lambda u: u = t)) <> len(list_filter(y, lambda u: u = t))) AS d FROM j WHERE j >= 0.5),
  k AS (SELECT a, b, j, list_sort(list_filter(d, lambda t: t NOT IN ({_NO_CLAIM}) AND regexp_matches(t, '\pL') AND NOT regexp_matches(t, '(?i)^(?:\$?\d[\d,.]*[km%]?|\[\[.*|https?:.*|[~./\\].*|.*[/\\].*|.*\.md)$'))) AS d FROM d)
  SELECT a AS older, b AS newer, round(j, 6) AS j, array_to_string(d, ' ') AS differ FROM k WHERE len(d) > 0""")
def _(s):
    """Anchored sentence pairs of similar nodes with the claim-bearing words that differ; the older one loses."""
    pairs = similarity.jaccard_pairs(pool_sets(s), 0.5)
    found = contradict.evidence(pairs, s.src.select("id", T.sentences(F.col("content")).alias("ss")), 0.5)
    return found.select("older", "newer", F.round("score", 6).alias("j"), F.array_join("differ", " ").alias("differ"))
