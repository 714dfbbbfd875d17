"""Personal data: base patterns, and information-theoretic sanitisation of the terms that give them away.

Base spans (email, ip, card, phone) are found in every whole text by linear-time matching.

Terms: a base span is a protected entity (kind and value). Its contexts are the ``REACH`` words on either side; equal contexts
count once, so copies of a text prove nothing. With N windows in the corpus, an entity e seen in c(e) contexts, a term t that
occurs tf(t) times in the whole corpus and in c(e, t) contexts of e::

    disclosure(t -> e) = PMI(e; t) / I(e) = log(c(e, t) N / (c(e) tf(t))) / log(N / c(e))

which is 1 where the term tells all that the entity's value would. ``tf`` and N are counted over all different texts, so copies
change neither side of the ratio. The same is estimated over whole texts, which are then the contexts: N different texts, of
which c(e) hold e, tf(t) hold t and c(e, t) hold both. Terms with at least ``SUPPORT`` contexts and a disclosure of at least
``DISCLOSURE`` in either count would still reveal the entity after it is masked, so they are removed, too, wherever they stand
in a text that holds the entity.

Whole texts are counted only for entities of ``SUPPORT`` different texts or more and for terms whose tf allows the disclosure at
all: as c(e, t) <= c(e), that is ``SUPPORT <= tf(t) <= N (c(e) / N) ** DISCLOSURE``.

Hashes and counts are shuffled: partial counts of each task, and the contexts of the few texts with base spans. Of texts with
copies, one is counted; these are shuffled, too (all texts, where more than ``COPIED`` different ones have copies).

Defined results: null and empty texts have no spans; ids are only carried along, so rows with equal or null ids are each
reported and masked by their own text; a base span of two kinds is kept for each kind; an empty table gives an empty result;
other columns are ignored, and kept by ``sanitise``, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hubs, join_by_share
from ..shared import bounded_batches, free_name, materialise
from . import textvec
from .words import column_slices, release, releasing

REACH, SUPPORT, DISCLOSURE = 5, 3, 0.9
KINDS = ("email", "ip", "card", "phone", "term")
SPAN = "struct<start:int,kind:int,end:int>"
_SLICE, COPIED = 500_000, 500_000
#: Term spans (16 bytes each) up to which ``sanitise`` broadcasts them.
SMALL = 500_000

# leftmost matches are the same with possessive runs, which fail in linear time
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d *= 1 + k % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, ordered by start, then kind."""
    if not text:
        return []
    out = []
    if "@" in text:
        before = 0
        for m in _DOMAIN.finditer(text):
            at = m.start()
            while at > before and text[at - 1] in _LOCAL:
                at -= 1
            if at < m.start():
                out.append((at, 0, m.end()))
                before = m.end()
            else:
                before = max(before, m.start() + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _hash64(data: str) -> int:
    return int.from_bytes(hashlib.blake2b(data.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _find(reach: int):
    """For each row its base spans, their entities, (entity, context, term) for the words around them, and, where there are base
    spans, all words beside these: (term, start, end)."""
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    near = pa.struct([("e", pa.int64()), ("c", pa.int64()), ("t", pa.int64())])
    word = pa.struct([("t", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.string()), ("base", pa.list_(span)), ("ents", pa.list_(pa.int64())), ("near", pa.list_(near)), ("words", pa.list_(word))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("h")
            for a, b, part in column_slices(batch.column("text"), _SLICE):
                base = [base_spans(t) for t in part]
                some = [k for k, x in enumerate(base) if x]
                w = textvec.words([part[k] for k in some])
                terms, around, ents, kept = w.hash.view(np.int64), [[] for _ in part], [[] for _ in part], np.ones(len(w.hash), dtype=bool)
                for n, k in enumerate(some):
                    lo, hi = int(w.first[n]), int(w.first[n + 1])
                    start, end, own = w.start[lo:hi], w.end[lo:hi], terms[lo:hi]
                    clear = kept[lo:hi]
                    for s, _, e in base[k]:
                        clear[np.searchsorted(end, s, side="right") : np.searchsorted(start, e, side="left")] = False
                    left_to = np.flatnonzero(clear)
                    for s, kind, e in base[k]:
                        i = int(np.searchsorted(end[left_to], s, side="right"))
                        chosen = left_to[max(0, i - reach) : i + reach]
                        entity, context = _hash64(f"{kind}:{part[k][s:e].lower()}"), _hash64(own[chosen].tobytes().hex())
                        around[k] += [{"e": entity, "c": context, "t": int(own[x])} for x in chosen]
                        ents[k].append(entity)
                size = np.zeros(len(part), dtype=np.int64)
                size[some] = np.add.reduceat(np.r_[kept, False], w.first[:-1], dtype=np.int64)[: len(some)] * (np.diff(w.first) > 0) if some else 0
                words = pa.StructArray.from_arrays([pa.array(terms[kept]), pa.array(w.start[kept].astype(np.int32)), pa.array(w.end[kept].astype(np.int32))], fields=list(word))
                yield pa.RecordBatch.from_arrays([
                    ids.slice(a, b - a), hashes.slice(a, b - a),
                    pa.array([[{"start": s, "kind": kind, "end": e} for s, kind, e in x] for x in base], pa.list_(span)), pa.array([sorted(set(x)) for x in ents], pa.list_(pa.int64())),
                    pa.array(around, pa.list_(near)), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), words),
                ], schema=schema)

    return releasing(run)


@releasing
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each word of a slice of texts, by hash, and the texts that hold it."""
    for batch in batches:
        for _, _, texts in column_slices(batch.column("text"), _SLICE):
            w = textvec.words(texts)
            if len(w.hash):
                term = w.hash.view(np.int64)
                order = np.argsort(term, kind="stable")
                term, doc = term[order], w.doc[order]
                new = np.r_[True, term[1:] != term[:-1]]
                first = np.flatnonzero(new)
                held = np.add.reduceat((new | np.r_[True, doc[1:] != doc[:-1]]).astype(np.int64), first)
                yield pa.RecordBatch.from_arrays([pa.array(term[first]), pa.array(np.diff(np.r_[first, len(term)]).astype(np.int64)), pa.array(held)], ["t", "n", "d"])


def _gain(both: str, entity: str, term: str, windows: float) -> F.Column:
    pmi = F.log(F.col(both) * F.lit(windows) / (F.col(entity) * F.col(term)))
    return F.when(F.col(entity) < F.lit(windows), pmi / F.log(F.lit(windows) / F.col(entity)))


def _terms(docs: DataFrame, reach: int = REACH, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, h, base, ...) of every row, (h, terms) of the texts that have terms, and (h, n) of those that n > 1 rows have."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = rows.withColumn("h", F.md5(F.coalesce("text", F.lit(""))))
    columns = f"doc_id long, h string, base array<{SPAN}>, ents array<long>, near array<struct<e:long,c:long,t:long>>, words array<struct<t:long,start:int,end:int>>"
    found = materialise(keyed.mapInArrow(_find(reach), columns), "op6-spans")
    by_text = found.groupBy("h").agg(F.count("*").alias("n"))
    texts = float(by_text.count())
    copied = materialise(by_text.where("n > 1"), "op6-copied")
    once = keyed.dropDuplicates(["h"])
    if copied.count() <= COPIED:  # then only texts with copies are moved
        once = keyed.join(F.broadcast(copied.select("h")), "h", "left_anti").unionByName(keyed.join(F.broadcast(copied.select("h")), "h", "left_semi").dropDuplicates(["h"]))
    counted = once.select("text").mapInArrow(_count, "t long, n long, d long")
    tf = materialise(counted.groupBy("t").agg(F.sum("n").alias("tf"), F.sum("d").alias("df")), "op6-counts")
    windows = float(tf.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]) / (2 * reach + 1)
    # the words around
    near = found.where(F.size("near") > 0).select(F.explode("near").alias("n")).select("n.*")
    of_entity = near.select("e", "c").distinct().groupBy("e").agg(F.count("*").alias("ce"))
    together = near.distinct().groupBy("e", "t").agg(F.count("*").alias("cet")).where(F.col("cet") >= support)
    told = together.join(of_entity, "e").join(tf, "t").where(_gain("cet", "ce", "tf", windows) >= disclosure).select("e", "t")
    # whole texts: the entities of each, then the terms that can reach the disclosure
    held = materialise(found.where(F.size("ents") > 0).select("h", F.explode("ents").alias("e")).distinct(), "op6-held")
    often = held.groupBy("e").agg(F.count("*").alias("ce")).where((F.col("ce") >= support) & (F.col("ce") < texts))
    most = F.lit(texts) * F.pow(F.col("ce") / F.lit(texts), F.lit(disclosure)) * 1.000001
    live = held.join(often, "e").withColumn("most", most)
    largest = often.agg(F.max(most)).first()[0] or 0.0
    in_text = found.where(F.size("words") > 0).join(live.select("h").distinct(), "h", "left_semi").select("h", F.explode(F.array_distinct(F.transform("words", lambda x: x["t"]))).alias("t")).distinct()
    in_text = in_text.join(tf.where((F.col("df") >= support) & (F.col("df") <= largest)).select("t", "df"), "t")
    pairs = in_text.join(live, "h").where(F.col("df") <= F.col("most"))
    pairs = pairs.groupBy("e", "t", "ce", "df").agg(F.count("*").alias("cet")).where(F.col("cet") >= support)
    told = materialise(told.union(pairs.where(_gain("cet", "ce", "df", texts) >= disclosure).select("e", "t")).distinct(), "op6-told")
    # each occurrence in each text that holds the entity
    hidden = held.join(told, "e").select("h", "t").distinct()
    listed = found.where(F.size("words") > 0).join(hidden.select("h").distinct(), "h", "left_semi").select("h", F.explode("words").alias("w")).select("h", "w.*").distinct()
    extra = listed.join(hidden, ["h", "t"], "left_semi").groupBy("h").agg(F.array_sort(F.collect_set(F.struct("start", F.lit(4).alias("kind"), "end"))).alias("terms"))
    return found, extra, copied


def find(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, h, base, terms) for every row: spans as (start, kind, end); h is the text's MD5."""
    found, extra, copied = _terms(docs, **options)
    hot = hubs(copied, "h", "n", found.count())
    out = join_by_share(found.select("doc_id", "h", "base"), extra, "h", hot, "left").select("doc_id", "h", "base", "terms")
    return out.withColumn("terms", F.coalesce("terms", F.array().cast(f"array<{SPAN}>")))


def spans_text(spans) -> F.Column:
    """kind:start:end by start, then kind, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def _masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    pieces, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            pieces += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*pieces, text[at:]])


def _sanitise(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Texts with their base spans, which are found here, and their terms, which come with them, masked."""
    for texts, terms in batches:
        out = []
        for text, own in zip(texts, terms, strict=True):
            spans = base_spans(text)
            out.append(_masked(text, spans + [(s["start"], s["kind"], s["end"]) for s in (own if own is not None else ())]) if spans else text)
        yield pd.Series(out, dtype=object)
    release()


_sanitise.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}


def sanitise(docs: DataFrame, small: int = SMALL, **options) -> DataFrame:
    """docs with their spans replaced by the kind in brackets; all other columns and rows are kept, whatever their ids.

    Base spans are a matter of the text alone. Terms come by the text's hash, from a broadcast table if it has up to ``small``
    spans, so that texts move only beyond that."""
    key, terms = free_name(docs, "h"), free_name(docs, "terms")
    extra = materialise(_terms(docs, **options)[1].select(F.col("h").alias(key), F.col("terms").alias(terms)), "op6-terms")
    spans = extra.agg(F.coalesce(F.sum(F.size(terms)), F.lit(0))).first()[0]
    marked = docs.withColumn(key, F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    joined = marked.join(F.broadcast(extra) if spans <= small else extra, key, "left")
    return joined.withColumn("text", F.pandas_udf(_sanitise, "string")(F.col("text").cast("string"), terms)).select(*docs.columns)


def op6_pii(spark, sf_dir):
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    base = spans_text(F.col("base"))
    return found.select(
        "doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(4)),
        F.sha2(base, 256).alias("base_sha256"), spans_text(F.concat("base", "terms")).alias("spans"), F.size("terms").cast("long").alias("n_term"),
        F.size(F.concat("base", "terms")).cast("long").alias("n_spans"),
    )
