"""Embedding near-dedup: all pairs with cosine >= threshold, exactly, by int8 tile products with error bounds.

1. Equal vectors become one class; links count with the class sizes.
2. Classes are packed into blocks of vectors that lie near the same pivots. A block has at most about ``BLOCK`` vectors and
   ``BLOCK_BYTES`` bytes, whatever the input. It holds int8 codes with scales and error norms, the vectors themselves for the exact
   check, and for each pivot the range of its vectors' angles to it.
3. Tiles are pairs of blocks. They are planned by a join of the blocks' ranges: two blocks can hold a linked pair only if all
   their ranges come within arccos(threshold) (triangle inequality of angles), so they share a bin of the first pivot's angle,
   widened by that much; the other pivots are tested on the pairs of a bin. Blocks meet their tiles by shuffles.
4. A unit vector is ``u = s q + e`` with int8 q and the norm ``|e|`` kept. ``u.v <= s_u s_v q_u.q_v + |s_u q_u| |e_v| + |e_u|``
   bounds the cosine from above; one matrix product of the codes with two more columns gives the whole bound, plus
   ``_rounding``, which bounds what single precision loses. Only pairs whose bound reaches the threshold are computed again, in
   double precision; those within 1e-9 of the threshold in one order of summation, so that no link depends on its tile.
5. A tile returns link counts and a spanning forest of its links, never all pairs of a group.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as do rows without
an id; vectors of different lengths are never linked; every row gives one row; different vectors under one id are linked for
themselves and share the smaller component id; extra columns (labels too) are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.skew import hubs, join_by_share
from ..shared import bounded_batches, materialise
from .words import release_if_large

THRESHOLD = 0.95
#: Vectors in a block and bytes of it, pivots, rows of a tile that are compared at once, candidates that are computed at once.
BLOCK, BLOCK_BYTES, PIVOTS, SUB, AT_ONCE = 16_384, 8_000_000, 48, 1024, 1 << 16
_SLACK, _TIE = 1e-9, 1e-9


def usable(v):
    ok = F.col(v).isNotNull() & (F.size(v) > 0)
    ok &= F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return F.coalesce(ok & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(flat: np.ndarray) -> np.ndarray:
    x = flat.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the norm
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _quantise(u: np.ndarray) -> tuple[np.ndarray, ...]:
    """int8 codes, scale, error norm, norm of the quantised vector."""
    scale = np.abs(u).max(1) / 127.0
    q = np.rint(u / scale[:, None])
    back = q * scale[:, None]
    return q.astype(np.int8), scale, np.sqrt(((u - back) ** 2).sum(1)) + _SLACK, np.sqrt((back * back).sum(1))


def _rounding(dim: int) -> float:
    """What a bound may lose in single precision: each of dim + 2 products and sums, and both factors, by 2**-24 of at most 1.5."""
    return 1.5 * (dim + 8) * 2.0**-23


def _sides(q: np.ndarray, scale: np.ndarray, error: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrices whose product left_i . right_j bounds the cosine of i and j from above."""
    codes = q.astype(np.float32) * scale.astype(np.float32)[:, None]
    left = np.c_[codes, norm.astype(np.float32), (error + _rounding(q.shape[1])).astype(np.float32)]
    return left, np.c_[codes, error.astype(np.float32), np.ones(len(q), dtype=np.float32)]


def _forest(r: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Least reachable node of each of n nodes over the links r-c."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[r], label[c])
        new = label.copy()
        np.minimum.at(new, r, least)
        np.minimum.at(new, c, least)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


_BLOCK = "block long, v binary, weight binary, codes binary, scale binary, error binary, norm binary, vecs binary, low array<double>, high array<double>"


def _pack(pivots: np.ndarray, dim: int, dtype: str):
    """applyInArrow over the (block, v, weight, vec) of one block: the block as one row, with its angle ranges."""

    def run(table: pa.Table) -> pa.Table:
        flat = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        u = _unit(flat)
        angle = np.arccos(np.clip(u @ pivots.T, -1, 1))
        v, weight = (table.column(k).to_numpy().astype("<i8").tobytes() for k in ("v", "weight"))
        codes, *numbers = _quantise(u)
        row = [v, weight, codes.tobytes(), *(x.astype("<f8").tobytes() for x in numbers), flat.astype(dtype).tobytes()]
        release_if_large()
        ranges = [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (angle.min(0), angle.max(0))]
        return pa.table([pa.array([table.column("block")[0].as_py()], pa.int64()), *(pa.array([x], pa.binary()) for x in row), *ranges], [c.split()[0] for c in _BLOCK.split(", ")])

    return run


class _Side:
    """A block as a task holds it; unit vectors are made for candidates only."""

    def __init__(self, row: dict, dim: int, dtype: str):
        self.v, self.weight = (np.frombuffer(row[k], "<i8") for k in ("v", "weight"))
        q = np.frombuffer(row["codes"], np.int8).reshape(-1, dim)
        self.left, self.right = _sides(q, *(np.frombuffer(row[k], "<f8") for k in ("scale", "error", "norm")))
        self.vecs = np.frombuffer(row["vecs"], dtype).reshape(-1, dim)


def _cosines(x: np.ndarray, y: np.ndarray, r: np.ndarray, c: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (x[r], y[c]) of unit vectors reach the threshold in double precision."""
    exact = lambda at: np.einsum("ij,ij->i", x[r[at]], y[c[at]])
    if len(r) > 0.05 * len(x) * len(y):
        cos = (x @ y.T)[r, c]
    else:
        cos = np.concatenate([exact(slice(k, k + AT_ONCE)) for k in range(0, len(r), AT_ONCE)])
    close = np.flatnonzero(np.abs(cos - threshold) < _TIE)
    for k in range(0, len(close), AT_ONCE):
        cos[close[k : k + AT_ONCE]] = exact(close[k : k + AT_ONCE])
    return cos >= threshold


def _tile(dim: int, dtype: str, threshold: float):
    """applyInArrow over the one or two blocks of a tile: (kind 0: v, links) and (kind 1: a, b of a forest)."""
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        sides = [_Side(row, dim, dtype) for row in sorted(table.to_pylist(), key=lambda row: row["block"])]
        same = len(sides) == 1
        left, right = sides[0], sides[-1]
        counts = [np.zeros(len(s.v), dtype=np.int64) for s in ((left,) if same else (left, right))]
        edges: list[np.ndarray] = []
        for i in range(0, len(left.v), SUB):
            for j in range(i if same else 0, len(right.v), SUB):
                r, c = np.nonzero(left.left[i : i + SUB] @ right.right[j : j + SUB].T >= np.float32(threshold))
                if same and i == j:
                    r, c = r[r < c], c[r < c]
                if not len(r):
                    continue
                ok = _cosines(_unit(left.vecs[i : i + SUB]), _unit(right.vecs[j : j + SUB]), r, c, threshold)
                r, c = r[ok], c[ok]
                if not len(r):
                    continue
                np.add.at(counts[0], i + r, right.weight[j + c])
                np.add.at(counts[-1], j + c, left.weight[i + r])
                vi, vj = left.v[i : i + SUB], right.v[j : j + SUB]
                names = np.r_[vi, vj]
                label = _forest(r, len(vi) + c, len(names))
                moved = np.flatnonzero(label != np.arange(len(names)))
                pair = np.c_[names[moved], names[label[moved]]]
                edges.append(pair[pair[:, 0] != pair[:, 1]])
        a = [s.v[n > 0] for s, n in zip(sides, counts, strict=True)]
        b = [n[n > 0] for n in counts]
        pairs = np.unique(np.concatenate([np.zeros((0, 2), dtype=np.int64), *edges]), axis=0)
        n = sum(map(len, a))
        release_if_large()
        return pa.table([pa.array(np.r_[np.zeros(n, np.int32), np.ones(len(pairs), np.int32)]), pa.array(np.concatenate([*a, pairs[:, 0]])), pa.array(np.concatenate([*b, pairs[:, 1]]))], schema=schema)

    return run


def _plan(blocks: DataFrame, threshold: float) -> DataFrame:
    """(i, j), i <= j, of the blocks that can hold a linked pair."""
    theta = math.acos(threshold) + 1e-6
    bin_of = lambda x: F.floor(x / theta).cast("int")
    one = blocks.select(F.col("block").alias("i"), F.col("low").alias("li"), F.col("high").alias("hi"), bin_of(F.col("low")[0]).alias("bi"), F.explode(F.sequence(bin_of(F.col("low")[0]), bin_of(F.col("high")[0]))).alias("bin"))
    wide = (bin_of(F.col("low")[0] - theta), bin_of(F.col("high")[0] + theta))
    two = blocks.select(F.col("block").alias("j"), F.col("low").alias("lj"), F.col("high").alias("hj"), wide[0].alias("bj"), F.explode(F.sequence(*wide)).alias("bin"))
    near = F.forall(F.sequence(F.lit(0), F.size("li") - 1), lambda k: (F.get("lj", k) - F.get("hi", k) <= theta) & (F.get("li", k) - F.get("hj", k) <= theta))
    # a pair is made in the first bin that both have
    return one.join(two, "bin").where((F.col("i") <= F.col("j")) & (F.col("bin") == F.greatest("bi", "bj")) & near).select("i", "j")


def _links(classes: DataFrame, dim: int, dtype: str, threshold: float, block: int) -> DataFrame:
    """Tile results of the classes (v, weight, vec) of one vector length."""
    pivots = [r["vec"] for r in classes.orderBy(F.xxhash64("v"), "v").select("vec").limit(PIVOTS).collect()]  # PIVOTS rows
    pivots = _unit(np.array(pivots, dtype=np.float64).reshape(-1, dim))
    size = max(64, min(block, BLOCK_BYTES // (dim * (1 + np.dtype(dtype).itemsize))))

    def nearest(vecs: pd.Series) -> pd.Series:
        x = np.stack(vecs.to_numpy()) if len(vecs) else np.zeros((0, dim))
        return pd.Series((_unit(x) @ pivots.T).argmax(1) if len(x) else np.zeros(0, dtype=int))

    nearest.__annotations__ = {"vecs": pd.Series, "return": pd.Series}
    celled = materialise(classes.withColumn("pivot", F.pandas_udf(nearest, "int")("vec")), "op3-celled")
    # neighbouring pivots share a block, a crowded pivot is cut by a hash
    sizes = {r["pivot"]: r["count"] for r in celled.groupBy("pivot").count().collect()}  # PIVOTS rows
    start, at, filled = {}, 0, 0
    for k in sorted(sizes):
        if filled and filled + sizes[k] > size:
            at, filled = at + 1, 0
        pieces = max(1, math.ceil(sizes[k] / size))
        start[k] = (at, pieces)
        at, filled = (at, filled + sizes[k]) if pieces == 1 else (at + pieces, 0)
    own = F.lit(0)
    for k, (first, pieces) in start.items():
        own = F.when(F.col("pivot") == k, F.lit(first) + F.pmod(F.xxhash64("v"), F.lit(pieces)).cast("int")).otherwise(own)
    rows = celled.select(own.cast("long").alias("block"), "v", "weight", "vec")
    blocks = materialise(rows.groupBy("block").applyInArrow(_pack(pivots, dim, dtype), _BLOCK), "op3-blocks")
    plan = materialise(_plan(blocks.select("block", "low", "high"), threshold), "op3-plan")
    ends = plan.select("i", "j", F.col("i").alias("block")).unionByName(plan.where("i < j").select("i", "j", F.col("j").alias("block")))
    return ends.join(blocks.drop("low", "high"), "block").groupBy("i", "j").applyInArrow(_tile(dim, dtype, threshold), "kind int, a long, b long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    bounded_batches(vectors.sparkSession)
    kind = dict(vectors.dtypes)[vec_col]
    dtype, element = ("<f4", "float") if kind == "array<float>" else ("<f8", "double")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{element}>").alias("vec"))
    # -0.0 and 0.0 are the same component
    plain = F.transform("vec", lambda x: F.when(x == 0, F.lit(0).cast(element)).otherwise(x))
    rows = rows.select("id", F.when(usable("vec") & F.col("id").isNotNull(), plain).alias("vec"))
    # a vector goes by a digest of 128 bits, so the rows of a large class need no join on the vector itself
    digest = F.when(F.col("vec").isNotNull(), F.concat(F.hex(F.xxhash64("vec")), F.lit("."), F.hex(F.xxhash64(F.lit("more"), "vec"))))
    classes = rows.where("vec is not null").groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("weight"))
    classes = materialise(classes.withColumn("h", digest), "op3-classes")
    # a class goes by its least id; of several classes with one least id, all but the first go by a hash
    shared = materialise(classes.groupBy("id").agg(F.count("*").alias("n"), F.min("h").alias("h0")).where("n > 1").select("id", "h0"), "op3-shared-ids")
    if shared.head(1):
        named = classes.join(shared, "id", "left").withColumn("v", F.when(F.col("h0").isNull() | (F.col("h") == F.col("h0")), F.col("id")).otherwise(F.xxhash64("h")))
        classes = materialise(named.select("vec", "id", "weight", "h", "v"), "op3-classes")
    else:
        classes = classes.withColumn("v", F.col("id"))
    dims = [r["d"] for r in classes.select(F.size("vec").alias("d")).distinct().collect()]
    found = None
    for d in sorted(dims):
        part = _links(classes.where(F.size("vec") == d) if len(dims) > 1 else classes, d, dtype, threshold, block)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = materialise(found, "op3-links")
    links = found.where("kind = 0").groupBy(F.col("a").alias("v")).agg(F.sum("b").alias("others"))
    parts = connected_components(found.where("kind = 1").select("a", "b")).select(F.col("id").alias("v"), "component")
    named = classes.select("v", "id", "weight", "h").join(links, "v", "left").join(parts, "v", "left").withColumn("component", F.coalesce("component", "v"))
    if shared.head(1):  # a component's name may be a hash then
        named = materialise(named, "op3-named")
        least = materialise(named.groupBy("component").agg(F.min("id").alias("least"), F.count("*").alias("d")), "op3-least")
        named = join_by_share(named, least.drop("d"), "component", hubs(least, "component", "d", named.count())).withColumn("component", F.col("least"))
    named = materialise(named.select("h", "weight", "component", F.coalesce("others", F.lit(0)).alias("others")), "op3-named")
    joined = join_by_share(rows.select("id", digest.alias("h")), named, "h", hubs(named, "h", "weight", rows.count()), "left")
    alone = F.col("weight").isNull()
    component = F.when(alone, F.col("id")).otherwise(F.col("component"))
    n_links = F.when(alone, F.lit(0)).otherwise(F.col("weight") - 1 + F.col("others"))
    return joined.select(F.col("id").alias(id_col), n_links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op3_embedding_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS m FROM r GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT embeddings.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(embeddings.vec_id, coalesce(c.m, embeddings.vec_id)) AS component_id,
  embeddings.vec_id <= coalesce(c.m, embeddings.vec_id) AS kept
FROM embeddings LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
