"""Near-duplicates by ProbMinHash over weighted word shingles.

Weights are the counts of a text's shingles of five words. Each shingle's arrivals are a Poisson process of that rate,
dealt to K registers; a register keeps the shingle that arrived first, and a process ends when its next arrival is later
than all of its text's registers. Two texts agree in a register with the probability Jaccard similarity J_P of their weights.

1. One pass makes the signatures; texts equal in every character become one class (hash of the text, pre-aggregated).
2. ``BANDS`` bands of ``ROWS`` registers give buckets: the candidates are the pairs that share one. All are verified with the exact
   J_P of whole shingle sets, in two rounds, but for pairs that are connected already.
3. First each member is compared with the least member of each of its buckets. The links' components join most of what is
   alike, so most buckets hold one component and end here, those of large groups of copies among them.
4. Buckets with several components are compared in tiles, buckets of the same members once. A bucket of more than ``TILE``
   texts or ``TILE_BYTES`` is cut into blocks, and each pair of blocks is a tile of its own. Small buckets share tiles.
   Nothing is compared outside a bucket, so chains of loosely similar texts cost no more than their buckets.
5. A tile counts shared shingles by a matrix product and returns a spanning forest of its links, never its pairs. No candidate
   is dropped and there is no cap. Links give the classes.

Defined results: a text of fewer than five words is one shingle; null texts, texts without words and rows with a null id are
in a class of their own each, and kept; rows are told apart by id and text, so different texts under one id are classed for
themselves (unlinked ones then share a class_id, which is that id); equal rows are one document; where a class has several
texts of its least id, the one with the least hash is kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.skew import hubs, join_by_share
from ..shared import bounded_batches, materialise
from . import textvec
from .words import column_slices, release_if_large, releasing

#: 28 bands of 6 registers: two texts of similarity 0.8 share a bucket with probability 0.9998.
SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 28, 6
#: Texts, and bytes of shingles, that one side of a tile holds.
TILE, TILE_BYTES = 768, 12_000_000
_SLICE, _COLUMNS = 500_000, 4096


def weighted(texts: list, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, shingle, count), sorted by doc, then shingle."""
    code, doc = textvec.shingles(textvec.words(texts), n)
    order = np.lexsort((code, doc))
    code, doc = code[order], doc[order]
    new = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])]) if len(code) else np.zeros(0, int)
    return doc[new], code[new], np.diff(np.r_[new, len(code)])


def prob_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """n_docs x k registers: for each, the element of the first arrival (0: none)."""
    first = np.full(n_docs * k, np.inf)
    out = np.zeros(n_docs * k, dtype=np.uint64)
    time = np.zeros(len(doc))
    live_doc, live, rate, step = doc, element, weight.astype(np.float64), 0
    latest = np.full(n_docs, np.inf)
    while len(live):
        step += 1
        draw = textvec.mix(live + np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / rate
        own = live_doc[np.flatnonzero(np.r_[True, live_doc[1:] != live_doc[:-1]])]  # elements are sorted by text
        latest[own] = first.reshape(n_docs, k)[own].max(1)
        stay = time < latest[live_doc]
        live_doc, live, rate, time = live_doc[stay], live[stay], rate[stay], time[stay]
        register = live_doc * k + (textvec.mix(draw[stay] ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(k)).astype(np.int64)
        np.minimum.at(first, register, time)
        won = time == first[register]
        out[register[won]] = live[won]
    return out.reshape(n_docs, k)


def text_key(text: Column) -> Column:
    """128 bits that tell texts apart."""
    return F.substring(F.unhex(F.sha2(text.cast("string"), 256)), 1, 16)


def _sign(shingle: int, bands: int, rows: int):
    """(doc_id, h, bands) of every row; h and bands are null for rows without id or words."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = bands * rows
        salt = textvec.mix(np.arange(bands, dtype=np.uint64) + np.uint64(1))
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("h")
            for a, b, part in column_slices(batch.column("text"), _SLICE):
                doc, code, count = weighted(part, shingle)
                sig = prob_minhash(doc, code, count, len(part), k)
                key = np.zeros((len(part), bands), dtype=np.uint64) + salt
                for r in range(rows):
                    key = textvec.mix(key + sig.reshape(len(part), bands, rows)[:, :, r])
                own = ids.slice(a, b - a)
                has = (np.bincount(doc, minlength=len(part)) > 0) & own.is_valid().to_numpy(zero_copy_only=False)
                ends = pa.array(np.r_[0, np.cumsum(has)] * bands, pa.int32(), mask=np.r_[~has, False])
                lists = pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(key[has]).view(np.int64).ravel()))
                known = pa.array([k if ok else None for k, ok in zip(keys.slice(a, b - a).to_pylist(), has, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([own, known, lists], schema=schema)

    return releasing(run)


def _sets(shingle: int):
    """(v, x, w): shingles and weights of the rows whose text is that of the class; no weights where all are one."""
    schema = pa.schema([("v", pa.int64()), ("x", pa.binary()), ("w", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in column_slices(batch.column("text"), _SLICE):
                doc, code, count = weighted(texts, shingle)
                cut = np.searchsorted(doc, np.arange(len(texts) + 1))
                x = [code[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
                w = [b"" if (own := count[i:j]).max(initial=1) == 1 else own.astype("<u4").tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("v").slice(a, b - a), pa.array(x, pa.binary()), pa.array(w, pa.binary())], schema=schema)

    return releasing(run)


def probability_jaccard(x: np.ndarray, xw: np.ndarray, y: np.ndarray, yw: np.ndarray) -> float:
    """Exact J_P of two weighted sets with sorted keys: sum over shared d of 1 / sum over d' of max(x'/x_d, y'/y_d)."""
    every = np.union1d(x, y)
    if not len(every):
        return 0.0
    a, b = np.zeros(len(every)), np.zeros(len(every))
    a[np.searchsorted(every, x)], b[np.searchsorted(every, y)] = xw, yw
    shared = (a > 0) & (b > 0)
    if (a[shared] == 1).all() and (b[shared] == 1).all() and a.max(initial=0) <= 1 and b.max(initial=0) <= 1:
        return float(shared.sum() / len(every))
    with np.errstate(divide="ignore"):
        ratio = np.where(a > 0, b / np.maximum(a, 1e-300), np.inf)
    order = np.argsort(ratio, kind="stable")
    upto = np.r_[0, np.cumsum(a[order])]
    after = b.sum() - np.r_[0, np.cumsum(b[order])]
    at = np.searchsorted(ratio[order], ratio[shared], side="right")
    return float((1.0 / (upto[at] / a[shared] + after[at] / b[shared])).sum())


def _alike(x: tuple, y: tuple, threshold: float) -> bool:
    """Whether two (shingles, weights or None) have J_P of the threshold or more."""
    (xs, xw), (ys, yw) = x, y
    if min(len(xs), len(ys)) == 0:
        return False
    if xw is None and yw is None:
        small, large = (xs, ys) if len(xs) <= len(ys) else (ys, xs)
        if len(small) < threshold * len(large) - 1e-6:
            return False
        shared = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
        return shared / (len(xs) + len(ys) - shared) >= threshold
    return probability_jaccard(xs, np.ones(len(xs)) if xw is None else xw, ys, np.ones(len(ys)) if yw is None else yw) >= threshold


def _linked(sets: list, threshold: float, known: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the links among (shingles, weights or None) of one bucket, by position, beyond the components known."""
    n, sizes = len(sets), np.array([len(x) for x, _ in sets], dtype=np.float64)
    code, owner = np.concatenate([x for x, _ in sets]), np.repeat(np.arange(n), sizes.astype(np.int64))
    part = np.concatenate([np.full(len(x), 1 / max(1, len(x))) if w is None else w / w.sum() for x, w in sets]).astype(np.float32)
    flat = np.array([w is None for _, w in sets])
    order = np.argsort(code, kind="stable")
    code, owner, part = code[order], owner[order], part[order]
    new = np.r_[True, code[1:] != code[:-1]]
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1  # only shared shingles count
    keep = often[column]
    place = np.cumsum(often) - 1
    owner, column, part, width = owner[keep], place[column[keep]], part[keep], int(often.sum())
    shared, share = np.zeros((n, n), dtype=np.float32), np.zeros((n, n), dtype=np.float32)
    for a in range(0, width, _COLUMNS):  # columns are in order
        lo, hi = np.searchsorted(column, (a, a + _COLUMNS))
        m = np.zeros((n, min(_COLUMNS, width - a)), dtype=np.float32)
        m[owner[lo:hi], column[lo:hi] - a] = 1
        shared += m @ m.T
        if not flat.all():  # of each text's weight, the share on shingles of the other
            weighted_m = np.zeros_like(m)
            weighted_m[owner[lo:hi], column[lo:hi] - a] = part[lo:hi]
            share += weighted_m @ m.T
    both = flat[:, None] & flat[None, :]
    # sets: the exact test; weights: J_P is at most the smaller share
    near = np.where(both, shared >= threshold * (sizes[:, None] + sizes[None, :]) / (1 + threshold) - 1e-3, np.minimum(share, share.T) >= threshold - 1e-4)
    r, c = np.nonzero(np.triu(near & (known[:, None] != known[None, :]), 1))
    sure = both[r, c]
    root, out = np.searchsorted(np.unique(known), known), []
    root = np.unique(known, return_index=True)[1][root]  # the first of each component known
    for pick in (np.flatnonzero(sure), np.flatnonzero(~sure)):
        for x, y in zip(r[pick].tolist(), c[pick].tolist(), strict=True):
            a, b = x, y
            while root[a] != a:
                root[a] = root[root[a]]
                a = root[a]
            while root[b] != b:
                root[b] = root[root[b]]
                b = root[b]
            if a != b and _alike(sets[x], sets[y], threshold):
                root[max(a, b)] = min(a, b)
                out.append((x, y))
    return out


def _unpacked(table: pa.Table) -> list:
    return [(np.frombuffer(p.as_py(), "<u8"), np.frombuffer(q.as_py(), "<u4").astype(np.float64) if len(q.as_py()) else None) for p, q in zip(table.column("x"), table.column("w"), strict=True)]


def _edges(edges: list) -> pa.Table:
    release_if_large()
    return pa.table([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])


def _ties(threshold: float):
    """applyInArrow over a tile of buckets' least members g and those to be compared with them: the links."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("g", "ascending"), ("v", "ascending")])
        g, v, edges = table.column("g").to_numpy(), table.column("v").to_numpy(), []
        cuts = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            sets, at = _unpacked(table.slice(a, b - a)), np.flatnonzero(v[a:b] == g[a])
            edges += [(int(v[a + k]), int(g[a])) for k in range(b - a) if v[a + k] != g[a] and _alike(sets[at[0]], sets[k], threshold)] if len(at) else []
        return _edges(edges)

    return run


def _tile(threshold: float):
    """applyInArrow over one tile: the links between its buckets' members beyond their components c."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("g", "ascending"), ("v", "ascending")])
        g, v, known = (table.column(k).to_numpy() for k in ("g", "v", "c"))
        cuts, edges = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True]), []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            edges += [(int(v[a + p]), int(v[a + q])) for p, q in _linked(_unpacked(table.slice(a, b - a)), threshold, known[a:b])]
        return _edges(edges)

    return run


def _blocks(members: DataFrame, sets: DataFrame, tile: int, tile_bytes: int) -> tuple[DataFrame, int]:
    """(g, n, blocks) of groups of members(g, v): blocks that hold ``tile`` texts or ``tile_bytes`` each, and packs of small groups."""
    bytes_of = sets.select("v", (F.length("x") + F.length("w")).alias("bytes"))
    size = members.join(bytes_of, "v").groupBy("g").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    size = materialise(size.select("g", "n", F.greatest(F.ceil(F.col("n") / tile), F.ceil(F.col("bytes") / tile_bytes)).cast("int").alias("blocks")), "op7-groups")
    total = size.where("blocks = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return size, max(1, 4 * int(total) // tile)


def _verified(ties: DataFrame, members: DataFrame, sets: DataFrame, threshold: float, tile: int, tile_bytes: int) -> DataFrame:
    """Links (a, b) among the members (key, v) of the buckets; ties (v, least) are compared first."""
    first = ties.select(F.col("least").alias("g"), "v")
    size, packs = _blocks(first, sets, tile, tile_bytes)
    block = F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")
    pack = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("g"), F.lit(packs)).cast("int")).otherwise(-1)
    split = F.when(F.col("blocks") == 1, F.lit(-1).cast("long")).otherwise(F.col("g"))
    least = size.select("g", F.col("g").alias("v"), split.alias("t"), pack.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    dealt = first.join(size, "g").select("g", "v", split.alias("t"), pack.alias("i"), F.when(F.col("blocks") > 1, block).otherwise(0).alias("j")).unionByName(least)
    one = materialise(dealt.join(sets, "v").groupBy("t", "i", "j").applyInArrow(_ties(threshold), "a long, b long"), "op7-links")

    parts = connected_components(one).select(F.col("id").alias("v"), "component")
    known = members.join(parts, "v", "left").select("key", "v", F.coalesce("component", "v").alias("c"))
    known = materialise(known, "op7-members")
    # buckets of several components; those of the same members once
    open_ = known.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("v")).alias("x"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    open_ = open_.where("c0 <> c1").groupBy("n", "x", "lo", "hi").agg(F.min("key").alias("key")).select("key")
    left = materialise(known.join(open_, "key").select(F.col("key").alias("g"), "v", "c"), "op7-open")
    size, packs = _blocks(left, sets, tile, tile_bytes)
    placed = left.join(size, "g").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    small = placed.where("blocks = 1").select("g", "v", "c", F.lit(-1).cast("long").alias("t"), F.pmod(F.xxhash64("g"), F.lit(packs)).cast("int").alias("i"), F.lit(0).alias("j"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    large = placed.where("blocks > 1").select("g", "v", "c", "block", other.alias("o")).select("g", "v", "c", F.col("g").alias("t"), F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    two = small.unionByName(large).join(sets, "v").groupBy("t", "i", "j").applyInArrow(_tile(threshold), "a long, b long")
    return materialise(one.union(two), "op7-links")


def _classed(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE, tile: int = TILE, tile_bytes: int = TILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h) of every row, h null for rows in no class; (h, rows, class_id, best) of every different text, with its number
    of rows; best marks the text that is kept of its class."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select("doc_id", text_key(F.col("text")).alias("h"), "text")
    signed = materialise(docs.mapInArrow(_sign(shingle, bands, rows), "doc_id long, h binary, bands array<long>"), "op7-signatures")
    classes = signed.where("h is not null").groupBy("h").agg(F.min("doc_id").alias("id"), F.count("*").alias("rows"), F.first("bands").alias("bands"))
    classes = materialise(classes, "op7-classes")
    # a text goes by its least id; of several texts with one least id, all but the first go by a hash
    shared = materialise(classes.groupBy("id").agg(F.count("*").alias("n"), F.min("h").alias("h0")).where("n > 1").select("id", "h0"), "op7-shared-ids")
    if shared.head(1):
        named = classes.join(shared, "id", "left").withColumn("v", F.when(F.col("h0").isNull() | (F.col("h") == F.col("h0")), F.col("id")).otherwise(F.xxhash64("h")))
        classes = materialise(named.select("h", "id", "rows", "bands", "v"), "op7-classes")
    else:
        classes = classes.withColumn("v", F.col("id"))
    keys = classes.select("v", F.explode("bands").alias("key"))
    # texts without a partner in any bucket end here
    crowded = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("least")).where("n > 1").select("key", "least")
    members = materialise(keys.join(crowded, "key"), "op7-members")
    ties = materialise(members.where("v <> least").select("v", "least").distinct(), "op7-ties")

    wanted = classes.join(members.select("v").distinct(), "v").select("v", F.col("id").alias("wanted_id"), F.col("h").alias("wanted_h"))
    texts = docs.join(wanted, (F.col("doc_id") == F.col("wanted_id")) & (F.col("h") == F.col("wanted_h"))).select("v", "text")
    sets = texts.mapInArrow(_sets(shingle), "v long, x binary, w binary")
    if signed.where("h is not null").groupBy("doc_id", "h").count().where("count > 1").head(1):  # equal rows count once
        sets = sets.dropDuplicates(["v"])
    sets = materialise(sets, "op7-sets")
    parts = connected_components(_verified(ties, members.select("key", "v"), sets, threshold, tile, tile_bytes))

    placed = classes.select("h", "id", "rows", "v").join(parts.select(F.col("id").alias("v"), "component"), "v", "left").withColumn("component", F.coalesce("component", "v"))
    if shared.head(1):
        best = materialise(placed.groupBy("component").agg(F.min(F.struct("id", "h")).alias("b"), F.count("*").alias("d")), "op7-best")
        placed = join_by_share(placed, best.drop("d"), "component", hubs(best, "component", "d", placed.count())).select("h", "rows", F.col("b.id").alias("class_id"), (F.col("b.h") == F.col("h")).alias("best"))
    else:  # the component is the least id, and that id has one text
        placed = placed.select("h", "rows", F.col("component").alias("class_id"), (F.col("id") == F.col("component")).alias("best"))
    return signed.select("doc_id", "h"), materialise(placed, "op7-placed")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, kept) of every row: class_id is the least document id of the row's class; kept marks that document."""
    rows, classes = _classed(docs, **options)
    kept = F.coalesce((F.col("doc_id") == F.col("class_id")) & F.col("best"), F.lit(True))
    return join_by_share(rows, classes.drop("rows"), "h", hubs(classes, "h", "rows", rows.count()), "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), kept.alias("kept"))


def text_classes(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, h, n, kept) of every different document that is in a class, with its number of rows; h is its ``text_key``."""
    rows, classes = _classed(docs, **options)
    each = rows.where("h is not null").groupBy("doc_id", "h").agg(F.count("*").alias("n"))
    kept = (F.col("doc_id") == F.col("class_id")) & F.col("best")
    return materialise(join_by_share(each, classes.drop("rows"), "h", hubs(classes, "h", "rows", rows.count())).select("doc_id", "h", "n", kept.alias("kept")), "op7-rows")


def op7_near_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
