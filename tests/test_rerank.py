"""Learned re-ranking against a plain fit."""

import math
import random
import zlib

import numpy as np

from quillgraph.operators import rerank


def _newton(x, y, ridge):
    """Weighted mean loss with a ridge on all but the intercept, by Newton's steps."""
    x = np.c_[x, np.ones(len(x))]
    n = len(y)
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    hold = np.diag([ridge] * (x.shape[1] - 1) + [0.0])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (weight * (p - y)) / weight.sum() + hold @ w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x / weight.sum() + hold
        w -= np.linalg.solve(bend, slope)
    return w


def test_weights_equal_a_plain_fit(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = (x @ [1.0, -2.0, 0.2] + rng.normal(size=400) > 1.5).astype(float)
    model = rerank.fit(spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, label double"), ["a", "b", "c"])
    assert np.allclose([*model.weights, model.intercept], _newton(x, y, 0.01), atol=1e-4)
    assert rerank.fit(spark.createDataFrame([(1.0, 1.0)], "a double, label double"), ["a"]) is None


def test_features_and_held_out_queries(spark):
    rnd = random.Random(2)
    rows = {name: [(q, d, rnd.random()) for q in range(8) for d in rnd.sample(range(20), 6)] for name in ("x", "y")}
    rows["y"] += [(99, 1, 0.5), (99, 2, 0.5)]
    lists = {}
    for name, r in rows.items():
        ranked = [(q, d, s, 1 + sum(1 for p, e, t in r if p == q and (-t, e) < (-s, d))) for q, d, s in r]
        lists[name] = spark.createDataFrame(ranked, "qid long, id long, score double, rank int")
    feats = rerank.features(lists)
    got = {(r.qid, r.id): r for r in feats.collect()}
    for name, r in rows.items():
        for q, d, s in r:
            own = [t for p, _, t in r if p == q]
            dev = float(np.std(own))
            assert math.isclose(got[q, d][f"{name}_z"], (s - float(np.mean(own))) / dev if dev else 0.0, abs_tol=1e-9)
    assert got[99, 1].x_z == 0 and got[99, 1].y_rr == 1.0 and got[99, 2].y_rr == 0.5
    gold = spark.createDataFrame([(q, d) for q, d, s in rows["x"] if s > 0.6], "qid long, id long")
    out = rerank.rerank(feats, gold).collect()
    held = {q for q in [*range(8), 99] if zlib.crc32(str(q).encode()) % 2 == 1}
    assert {r.qid for r in out} == held and len(out) == sum(q in held for q, _ in got)
    none = rerank.rerank(feats, gold.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and all(r.rank == 1 + sum(o.qid == r.qid and o.id < r.id for o in none) for r in none)
