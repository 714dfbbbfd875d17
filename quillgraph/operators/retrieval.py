"""Ranked retrieval over (id, content): BM25, dense, sparse and late interaction, fused by reciprocal ranks.

All operators take a table of queries, so one plan serves any number of them, and an index: a table of texts, which ``build`` reads
and tokenises once for these queries, or what a ``textindex.TextIndex`` that stays gives for them. Statistics, document frequencies
and scores are made from that. Dense scores are matrix products of blocks of vectors with the queries, which are broadcast in chunks of a checked
size. Scores are rounded before they are ranked, ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from ..schema import K1, RRF_C, STEM_WIDTH, STOP, B
from ..shared import bounded_batches, materialise

DIGITS = 6


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term) of queries(qid, text)."""
    return queries.select("qid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))


#: Query terms that are broadcast; more are joined. Bytes of query vectors that are broadcast at once.
TERMS, QUERY_BYTES = 100_000, 32_000_000
_COUNTS = "id long, dl int, term string, tf long, h long, g long"


@dataclass
class Built:
    """An index as queries see it: postings(id, dl, term, tf) of their terms at least, and one row stats(n, avgdl) of all rows."""

    postings: DataFrame
    stats: DataFrame


def _count(shared):
    """mapInArrow over (id, content in lower case, h, g): one row (term null) for each row, and one for each of its terms, or of those that are
    wanted. The stems are those of ``functions.text.tokens``, cut, filtered and counted for a whole batch at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop = pa.array(sorted(STOP), pa.string())
        wanted = None if shared is None else pa.array(sorted(shared.value), pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                words = pc.split_pattern_regex(pc.fill_null(part.column("content"), ""), "[^a-z0-9]+")
                row, word = pc.list_parent_indices(words), pc.list_flatten(words)
                good = pc.and_(pc.greater(pc.binary_length(word), 0), pc.invert(pc.is_in(word, value_set=stop)))
                row, stem = row.filter(good), pc.utf8_slice_codeunits(word.filter(good), 0, STEM_WIDTH)
                dl = np.bincount(row.to_numpy(), minlength=part.num_rows).astype(np.int32)
                ids, h, g = part.column("id"), part.column("h"), part.column("g")
                none = pa.nulls(part.num_rows, pa.string()), pa.nulls(part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(dl), *none, h, g], _NAMES)
                if wanted is not None:
                    keep = pc.is_in(stem, value_set=wanted)
                    row, stem = row.filter(keep), stem.filter(keep)
                counts = pa.table({"row": row, "term": stem}).group_by(["row", "term"]).aggregate([([], "count_all")]).combine_chunks()
                if counts.num_rows:
                    own = counts.column("row").combine_chunks()
                    none = [pa.nulls(counts.num_rows, pa.int64())] * 2
                    yield pa.RecordBatch.from_arrays([ids.take(own), pa.array(dl[own.to_numpy()]), counts.column("term").combine_chunks(), counts.column("count_all").combine_chunks(), *none], _NAMES)

    return run


_NAMES = [c.split()[0] for c in _COUNTS.split(", ")]


def word_counts(index: DataFrame, wanted=None) -> DataFrame:
    """_COUNTS of index(id, content): for each row one without a term, with its length and digests of its text, and one for each
    term, of ``wanted`` (a broadcast set) if given."""
    rows = index.select(F.col("id").cast("long").alias("id"), F.lower("content").alias("content"), F.xxhash64("content").alias("h"), F.xxhash64(F.lit("g"), "content").alias("g"))
    return rows.mapInArrow(_count(wanted), _COUNTS)


def build(index: DataFrame, queries: DataFrame) -> Built:
    """Index of index(id, content) for these queries, made for this one use; each row is a document, whatever its id. With many
    query terms all postings are written, and those of the terms are found by a join."""
    spark = index.sparkSession
    terms = query_terms(queries).select("term").distinct()
    few = {r["term"] for r in terms.limit(TERMS + 1).collect()}
    bounded_batches(spark)
    small = len(few) <= TERMS
    counts = materialise(word_counts(index.select("id", "content"), spark.sparkContext.broadcast(few) if small else None).select("id", "dl", "term", "tf"), "postings")
    posts = counts.where("term is not null")
    stats = counts.where("term is null").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return Built(posts if small else posts.join(terms, "term", "left_semi").select("id", "dl", "term", "tf"), stats)


def weights(built: Built, queries: DataFrame) -> DataFrame:
    """(qid, term, n, avgdl, idf); terms that no document has keep their row."""
    df = built.postings.groupBy("term").agg(F.count("*").alias("df"))
    all_terms = query_terms(queries).join(df, "term", "left").crossJoin(F.broadcast(built.stats))  # one row of statistics
    df = F.coalesce("df", F.lit(0))
    return all_terms.select("qid", "term", "n", "avgdl", F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1.0).alias("idf"))


def bm25_parts(built: Built, queries: DataFrame) -> DataFrame:
    """(qid, id, term, part): what each query term adds to a document's score."""
    part = F.col("idf") * (F.col("tf") * (K1 + 1.0)) / (F.col("tf") + K1 * (1.0 - B + B * F.col("dl") / F.col("avgdl")))
    return built.postings.join(weights(built, queries), "term").select("qid", "id", "term", part.alias("part"))


def _built(index, queries: DataFrame) -> Built:
    """The index as it is given: ``Built``, or a table (id, content), for which one is built."""
    return index if isinstance(index, Built) else build(index, queries)


def bm25(index: DataFrame | Built, queries: DataFrame) -> DataFrame:
    """(qid, id, score) of all documents with a query term."""
    built = _built(index, queries)
    return bm25_parts(built, queries).groupBy("qid", "id").agg(F.round(F.sum("part"), DIGITS).alias("score"))


def coverage(index: DataFrame | Built, queries: DataFrame) -> DataFrame:
    """(qid, id, coverage): the BM25 score over the best that any document could reach; unknown terms count in the ceiling."""
    built = _built(index, queries)
    top = weights(built, queries).groupBy("qid").agg(F.sum(F.col("idf") * (K1 + 1.0)).alias("top"))
    raw = bm25_parts(built, queries).groupBy("qid", "id").agg(F.sum("part").alias("raw"))
    return raw.join(top, "qid").select("qid", "id", F.round(F.least(F.lit(1.0), F.col("raw") / F.col("top")), DIGITS).alias("coverage"))


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt((rows * rows).sum(1, keepdims=True))
    return np.divide(rows, size, out=np.full_like(rows, np.nan), where=size > 0)


def _scores(shared, k: int | None):
    """mapInArrow over (id, vec): (qid, id, score), of each batch the first k of a query if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim in {len(v) for _, v in shared.value}:
            own = [(q, v) for q, v in shared.value if len(v) == dim]
            by_dim[dim] = np.array([q for q, _ in own], dtype=np.int64), _unit(np.array([v for _, v in own], dtype=np.float64))
        for batch in batches:
            ids, vecs = batch.column("id").to_numpy(zero_copy_only=False), batch.column("vec")
            sizes = pc.fill_null(pc.list_value_length(vecs), 0).to_numpy(zero_copy_only=False)
            for dim, (qids, q) in by_dim.items():
                at = np.flatnonzero(sizes == dim)
                for a in range(0, len(at), 1024):
                    own = at[a : a + 1024]
                    x = _unit(vecs.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))
                    score = np.round(x @ q.T, DIGITS)
                    if k is None or len(own) <= k:
                        r, c = np.nonzero(~np.isnan(score))
                    else:
                        first = np.lexsort((np.broadcast_to(ids[own][:, None], score.shape), -score), axis=0)[:k]
                        c = np.broadcast_to(np.arange(len(qids)), first.shape).ravel()
                        r = first.ravel()
                        ok = ~np.isnan(score[r, c])
                        r, c = r[ok], c[ok]
                    yield pa.RecordBatch.from_arrays([pa.array(qids[c]), pa.array(ids[own][r]), pa.array(score[r, c])], ["qid", "id", "score"])

    return run


def dense(vectors: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """(qid, id, score): cosine of vectors(id, vec) and queries(qid, vec), a stated query set; with k at least the first k of each
    query. Queries are broadcast in chunks of ``QUERY_BYTES``, each with a pass over the vectors. Null vectors, zero vectors and
    other lengths than the query's give no row."""
    good = F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull())
    spark = vectors.sparkSession
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).where(good & F.col("id").isNotNull())
    q = queries.select(F.col("qid").cast("long").alias("qid"), F.col("vec").cast("array<double>").alias("vec")).where(good & F.col("qid").isNotNull())
    total = q.agg(F.coalesce(F.sum(F.size("vec") * 8), F.lit(0))).first()[0]
    chunks = max(1, math.ceil(2 * total / QUERY_BYTES)) if total > QUERY_BYTES else 1
    out = None
    for chunk in range(chunks):
        own = q if chunks == 1 else q.where(F.pmod(F.xxhash64("qid"), F.lit(chunks)) == chunk)
        shared = spark.sparkContext.broadcast([(r["qid"], r["vec"]) for r in own.collect()])
        part = rows.mapInArrow(_scores(shared, k), "qid long, id long, score double")
        out = part if out is None else out.unionByName(part)
    return out


def sparse(index: DataFrame | Built, queries: DataFrame) -> DataFrame:
    """(qid, id, score): dot product of term frequencies over shared terms."""
    built = _built(index, queries)
    q = queries.select("qid", F.explode(tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("w"))
    return built.postings.join(q, "term").groupBy("qid", "id").agg(F.sum(F.col("tf") * F.col("w")).cast("double").alias("score"))


def ranked(scores: DataFrame, k: int | None = None) -> DataFrame:
    """With rank within the query, score first, then id; only the first k if given."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")))
    return out if k is None else out.where(F.col("rank") <= k)


def rrf(*lists: DataFrame, weights: tuple[float, ...] | None = None) -> DataFrame:
    """(qid, id, score) fused from ranked lists(qid, id, rank)."""
    weights = weights or (1.0,) * len(lists)
    parts = None
    for x, w in zip(lists, weights, strict=True):
        part = x.select("qid", "id", (F.lit(float(w)) / (RRF_C + F.col("rank"))).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("qid", "id").agg(F.round(F.sum("part"), DIGITS).alias("score"))


def retrieve(index: DataFrame | Built, pool: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, depth: int = 50) -> DataFrame:
    """Hybrid scores. Statistics are the index's, ranks are taken inside the pool, so excluded nodes eat no slots."""
    built, pool = _built(index, queries), materialise(pool.select("id").distinct(), "pool")
    inside = lambda scores: ranked(scores.join(pool, "id", "left_semi"), depth)
    near = dense(vectors.join(pool, "id", "left_semi"), query_vectors, depth)
    return rrf(inside(bm25(built, queries)), ranked(near, depth), inside(sparse(built, queries)))
