"""Centroid clustering (Lloyd's rounds) with ball-tree filtering, exact in integers.

1. Components become integers. Each Arrow slice of vectors becomes one metric tree, built where the rows lie: a ball keeps its
   radius, count and exact integer sum, and halves by its two far points down to leaves of ``LEAF`` vectors. Trees are written
   once to the shared folder, vectors in tree order, and read by every round.
2. A round walks all balls of a tree level by level. A centroid that is farther from a ball's centre than the nearest one by more
   than two radii can be nearest to none of its vectors (triangle inequality). A ball with one centroid left is assigned whole,
   by its count and sum; others hand what is left to their halves; vectors of open leaves are compared exactly.
   Distances to centres are bounded for rounding, so a ball is assigned whole only where every vector has that one nearest.
3. A task returns counts and sums by centroid and component, which are summed before and after the shuffle: k x dim numbers reach
   the driver, whatever the input, and become the next centroids, exactly floor(sum / count).

Copies of one vector are balls of radius 0, so a common vector costs one comparison a tree. A tree takes ``TREE`` vectors at most,
which bounds a task's memory.

Defined results: vectors that are null, of another length than ``dim``, or hold null or non-finite components are left out, as are
those with a component of 2**20 or more, whose squared distances might not fit; rows with equal ids are separate; ties of the
first centroids' hashes (equal ids) go by the vectors; rows without an id come last among them; fewer vectors than k give as many
centroids; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import bounded_batches, materialise
from .words import releasing

DIM, K, ROUNDS, SCALE = 64, 16, 3, 64
#: Vectors in a tree and in a leaf; components must be smaller than this.
TREE, LEAF, LARGEST = 8192, 24, 1 << 20
_NODES = "n int, dim int, ids binary, has binary, vecs binary, first binary, count binary, half binary, radius binary, sums binary"


def _build(x: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """Order of the vectors and the balls (first, count, number of the first half or -1, radius, sum), parents first, halves side
    by side."""
    order = np.arange(len(x))
    balls: list[list] = [[0, len(x), -1, 0.0, None]]
    for k in range(2 * len(x)):
        if k == len(balls):
            break
        first, count = balls[k][:2]
        at = order[first : first + count]
        part = x[at]
        total = part.sum(0)
        from_centre = ((part - total / count) ** 2).sum(1)
        balls[k][3], balls[k][4] = float(np.sqrt(from_centre.max())), total
        if count <= LEAF or balls[k][3] == 0 or (part == part[0]).all():
            continue
        a = part[from_centre.argmax()]
        from_a = ((part - a) ** 2).sum(1)
        b = part[from_a.argmax()]
        side = from_a > ((part - b) ** 2).sum(1)
        order[first : first + count] = np.r_[at[~side], at[side]]
        balls[k][2] = len(balls)
        n = int(count - side.sum())
        balls += [[first, n, -1, 0.0, None], [first + n, count - n, -1, 0.0, None]]
    return order, balls


def _trees(dim: int, tree: int):
    """mapInArrow over (id, x): one row for each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, tree):
                part = batch.slice(k, tree)
                ids = part.column("id")
                has = np.asarray(ids.is_valid())
                number = np.asarray(ids.fill_null(0)).astype("<i8")
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                order, balls = _build(x.astype(np.float64))
                first, count, half = (np.array([b[j] for b in balls], dtype="<i4") for j in range(3))
                radius, sums = np.array([b[3] for b in balls], dtype="<f8"), np.array([b[4] for b in balls]).astype("<i8")
                parts = [number[order], has[order], x[order].astype("<i4"), first, count, half, radius, sums]
                row = [pa.array([len(x)], pa.int32()), pa.array([dim], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)]
                yield pa.RecordBatch.from_arrays(row, [c.split()[0] for c in _NODES.split(", ")])

    return releasing(run)


class _Tree:
    def __init__(self, row: dict):
        self.n, dim = row["n"], row["dim"]
        self.ids, self.has = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["has"], bool)
        #: Below LARGEST, products and sums of up to 2**12 components are whole numbers in double precision.
        self.x = np.frombuffer(row["vecs"], "<i4").reshape(-1, dim).astype(np.float64)
        self.first, self.count, self.half = (np.frombuffer(row[c], "<i4") for c in ("first", "count", "half"))
        self.radius, self.sums = np.frombuffer(row["radius"], "<f8"), np.frombuffer(row["sums"], "<i8").reshape(-1, dim)

    def walk(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(balls that are assigned whole, their centroids, other vectors' places, their centroids)."""
        k, dim = z.shape
        centre = self.sums / self.count[:, None]
        zz, cc = (z * z).sum(1), (centre * centre).sum(1)
        # rounding of centre, products and sums, of squared distances and radii
        slack = (dim + 16) * 2.0**-51 * (np.sqrt(cc)[:, None] + np.sqrt(zz)) ** 2
        radius = self.radius * (1 + 2.0**-40) + np.sqrt(slack.max(1))
        whole, whole_z, open_rows, open_left = [], [], [], []
        balls, left = np.zeros(1, dtype=np.int64), np.ones((1, k), dtype=bool)
        while len(balls):
            squared = cc[balls][:, None] - 2 * (centre[balls] @ z.T) + zz
            low, high = (np.sqrt(np.maximum(squared + s * slack[balls], 0)) for s in (-1, 1))
            least = np.where(left, high, np.inf).min(1)
            left = left & (low <= (least + 2 * radius[balls])[:, None])
            one = left.sum(1) == 1
            whole.append(balls[one])
            whole_z.append(left[one].argmax(1))
            leaf = ~one & (self.half[balls] < 0)
            for ball, mask in zip(balls[leaf].tolist(), left[leaf], strict=True):
                rows = np.arange(self.first[ball], self.first[ball] + self.count[ball])
                open_rows.append(rows)
                open_left.append(np.broadcast_to(mask, (len(rows), k)))
            inner = ~one & ~leaf
            halves = self.half[balls[inner]]
            balls, left = np.r_[halves, halves + 1], np.r_[left[inner], left[inner]]
        rows = np.concatenate([np.zeros(0, np.int64), *open_rows])
        mask = np.concatenate([np.zeros((0, k), bool), *open_left])
        # |x|^2 is the same for all centroids; all numbers are whole; the first of equals is the smaller number
        score = np.where(mask, zz - 2 * (self.x[rows] @ z.T), np.inf)
        return np.concatenate(whole), np.concatenate(whole_z), rows, score.argmin(1) if len(rows) else np.zeros(0, np.int64)


def _sums(centroids: list[list[int]]):
    """mapInArrow over trees: (cluster, part, total), where part -1 is the count and others are components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = np.array(centroids, dtype=np.float64)
        total = np.zeros((len(z), z.shape[1] + 1), dtype=np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                tree = _Tree(batch.slice(k, 1).to_pylist()[0])
                balls, own, rows, near = tree.walk(z)
                np.add.at(total, own, np.c_[tree.count[balls], tree.sums[balls]])
                np.add.at(total, near, np.c_[np.ones(len(rows), np.int64), tree.x[rows].astype(np.int64)])
        c, p = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array((p - 1).astype(np.int32)), pa.array(total[c, p])], ["cluster", "part", "total"])

    return releasing(run)


def _assign(centroids: list[list[int]]):
    """mapInArrow over trees: (id, cluster, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = np.array(centroids, dtype=np.float64)
        for batch in batches:
            for k in range(batch.num_rows):
                tree = _Tree(batch.slice(k, 1).to_pylist()[0])
                balls, own, rows, near = tree.walk(z)
                cluster = np.zeros(tree.n, dtype=np.int32)
                for ball, c in zip(balls.tolist(), own.tolist(), strict=True):
                    cluster[tree.first[ball] : tree.first[ball] + tree.count[ball]] = c
                cluster[rows] = near
                distance = ((tree.x - z[cluster]) ** 2).sum(1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(tree.ids, mask=~tree.has), pa.array(cluster), pa.array(distance)], ["id", "cluster", "distance"])

    return releasing(run)


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """(id, x) of the vectors that are kept, x = floor(scale * component)."""
    element = F.lit(float(scale))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    # null, NaN and infinite components fail the comparison
    fits = F.forall("v", lambda c: F.coalesce(F.abs(F.floor(c * element)) < LARGEST, F.lit(False)) & ~F.isnan(c) & (F.abs(c) < LARGEST))
    return rows.where((F.size("v") == dim) & fits).select("id", F.transform("v", lambda c: F.floor(c * element).cast("int")).alias("x"))


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, tree: int = TREE) -> tuple[DataFrame, DataFrame]:
    """(id, cluster, distance) of every kept vector, and (cluster, n, cluster_inertia, centroid) of every centroid."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = whole_vectors(vectors, id_col, vec_col, dim, scale)
    by_hash = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    # k rows
    centroids = [list(r["x"]) for r in rows.orderBy(by_hash.asc_nulls_last(), "x").limit(k).collect()]
    shape = "id long, cluster int, distance long"
    about = "cluster int, n long, cluster_inertia long, centroid array<long>"
    if not centroids:
        return spark.createDataFrame([], shape), spark.createDataFrame([], about)
    trees = materialise(rows.mapInArrow(_trees(dim, tree), _NODES), "op12-trees")
    for _ in range(rounds):
        totals: dict[int, dict[int, int]] = {}
        # at most k x (dim + 1) rows
        for r in trees.mapInArrow(_sums(centroids), "cluster int, part int, total long").groupBy("cluster", "part").agg(F.sum("total").alias("total")).collect():
            totals.setdefault(r["cluster"], {})[r["part"]] = r["total"]
        for c, t in totals.items():
            centroids[c] = [t.get(j, 0) // t[-1] for j in range(dim)]
    found = materialise(trees.mapInArrow(_assign(centroids), shape), "op12-assigned")
    sizes = {r["cluster"]: r for r in found.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("distance").alias("total")).collect()}  # k rows
    rows = [(c, sizes[c]["n"] if c in sizes else 0, sizes[c]["total"] if c in sizes else 0, z) for c, z in enumerate(centroids)]
    return found, spark.createDataFrame(rows, about)


def op12_centroids(spark, sf_dir):
    found, about = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = about.collect()  # K rows
    total = sum(r["cluster_inertia"] for r in rows)
    named = [(r["cluster"], r["cluster_inertia"], total, hashlib.sha256(",".join(map(str, r["centroid"])).encode()).hexdigest()) for r in rows]
    side = F.broadcast(spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return found.withColumnRenamed("id", "vec_id").join(side, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """Rounds are written out; centroids are rows (c, j, z)."""
    nearest = """
n{r} AS (SELECT vec_id, rn, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT v.vec_id, v.rn, z.c, sum((v.x - z.z) * (v.x - z.z))::BIGINT AS d FROM x v JOIN z{r} z ON v.j = z.j GROUP BY 1, 2, 3) GROUP BY 1, 2)"""
    update = """,
z{s} AS MATERIALIZED (SELECT o.c, o.j, coalesce(m.z, o.z) AS z FROM z{r} o LEFT JOIN (
  SELECT n.c, v.j, floor(sum(v.x)::HUGEINT / count(*)::DOUBLE)::BIGINT AS z FROM n{r} n JOIN x v USING (rn) GROUP BY 1, 2) m ON o.c = m.c AND o.j = m.j),"""
    steps = "".join(nearest.format(r=r) + (update.format(r=r, s=r + 1) if r < ROUNDS else "") for r in range(ROUNDS + 1))
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) AS rn, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT vec_id, rn, j, floor({SCALE} * e[j])::BIGINT AS x FROM v, range(1, {DIM} + 1) t(j)),
z0 AS (SELECT (rn - 1)::INT AS c, j, x AS z FROM x WHERE rn <= {K}),{steps},
s AS (SELECT c, sha256(string_agg(z::VARCHAR, ',' ORDER BY j)) AS h FROM z{ROUNDS} GROUP BY 1)
SELECT vec_id, n.c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY n.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
FROM n{ROUNDS} n JOIN s ON n.c = s.c
"""


OP12_SQL = _sql()
