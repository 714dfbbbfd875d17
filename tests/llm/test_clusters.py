"""Centroid clustering against plain rounds in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from quillgraph.llm import op12_clusters as op12


def _plain(rows, k, rounds, dim, scale):
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) and abs(math.floor(scale * c)) < op12.LARGEST for c in v)]
    digest = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    z = [x for _, x in sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else digest(r[0]), r[1]))[:k]]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    near = lambda x: min((far(x, c), j) for j, c in enumerate(z))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        for j in set(own):
            part = [x for (_, x), o in zip(kept, own, strict=True) if o == j]
            z[j] = [sum(c) // len(part) for c in zip(*part, strict=True)]
    return sorted(((str(i), near(x)[1], near(x)[0]) for i, x in kept)), z


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, id int")


@pytest.mark.parametrize("kind", ["ties", "groups", "copies", "large"])
def test_equals_plain_rounds(spark, kind):
    rnd = random.Random(kind)
    draw = {
        "ties": lambda: [rnd.randint(-2, 2) / 64 for _ in range(4)],
        "groups": lambda: [rnd.choice([0, 5, 9]) + rnd.gauss(0, 0.3) for _ in range(4)],
        "copies": lambda: rnd.choice([[0.5] * 4, [0.5] * 4, [rnd.random() for _ in range(4)]]),
        "large": lambda: [rnd.choice([-1, 1]) * (16_000 + rnd.random() / 64) for _ in range(4)],
    }[kind]
    rows = [(k, draw()) for k in range(400)]
    rows += [(400, None), (401, []), (402, [1.0]), (403, [1.0, None, 0.0, 0.0]), (404, [math.nan] * 4), (405, [math.inf, 0.0, 0.0, 0.0]), (406, [1e300, 0.0, 0.0, 0.0]), (407, [-20_000.0, 0.0, 0.0, 0.0])]
    rows += [(3, rows[3][1]), (3, [0.1] * 4), (None, [0.2] * 4), (None, [0.2] * 4)]
    want, z = _plain(rows, 5, 3, 4, 64)
    found, about = op12.cluster(_frame(spark, rows), k=5, rounds=3, dim=4, tree=100)
    assert sorted((str(r.id), r.cluster, r.distance) for r in found.collect()) == want
    told = {r.cluster: r for r in about.collect()}
    assert [told[j].centroid for j in range(5)] == z
    assert {j: r.cluster_inertia for j, r in told.items()} == {j: sum(d for _, c, d in want if c == j) for j in range(5)}


def test_few_vectors_and_none(spark):
    found, about = op12.cluster(_frame(spark, [(1, [0.1] * 4), (2, [0.2] * 4)]), dim=4)
    assert sorted(map(tuple, found.collect())) == sorted((i, c, 0) for i, c in zip([1, 2] if hashlib.sha256(b"1:1").hexdigest() < hashlib.sha256(b"1:2").hexdigest() else [2, 1], [0, 1], strict=True))
    found, about = op12.cluster(_frame(spark, [(1, None)]), dim=4)
    assert found.count() == about.count() == 0


def test_balls_hold_what_they_say_and_are_assigned_whole():
    rnd = np.random.default_rng(1)
    x = np.concatenate([rnd.integers(-5, 5, (300, 8)) + c for c in (0, 200, 900)]).astype(np.int64)
    order, balls = op12._build(x.astype(np.float64))
    assert sorted(order) == list(range(900))
    for first, count, half, radius, total in balls:
        part = x[order[first : first + count]]
        assert (total == part.sum(0)).all()
        assert np.sqrt(((part - part.mean(0)) ** 2).sum(1)).max() <= radius + 1e-9
        if half >= 0:
            assert (balls[half][0], balls[half][1] + balls[half + 1][1]) == (first, count)
    fields = [np.array([b[j] for b in balls]) for j in range(3)]
    row = {"n": 900, "dim": 8, "ids": np.arange(900).tobytes(), "has": np.ones(900, bool).tobytes(), "vecs": x[order].astype("<i4").tobytes(), "first": fields[0].astype("<i4").tobytes()}
    row |= {"count": fields[1].astype("<i4").tobytes(), "half": fields[2].astype("<i4").tobytes(), "radius": np.array([b[3] for b in balls]).tobytes(), "sums": np.array([b[4] for b in balls]).astype("<i8").tobytes()}
    whole, _, rows, _ = op12._Tree(row).walk(np.array([[0.0] * 8, [200.0] * 8, [900.0] * 8]))
    assert len(rows) == 0 and fields[1][whole].sum() == 900 and len(whole) <= 6


def test_query_is_plain_clustering(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, z = _plain(rows, 16, 3, 64, 64)
    got = op12.op12_centroids(spark, sf).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got) == want
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in z]
    assert all(r.centroid_sha256 == sha[r.cluster] for r in got)
    assert {r.inertia for r in got} == {sum(d for _, _, d in want)}
