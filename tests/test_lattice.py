"""Values over deep and tangled graphs, against peeling layer by layer."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graph


def _peel(values, edges, pick, unresolved):
    known = {i: v for i, v, _ in values}
    fixed = {i for i, _, f in values if f}
    up = {}
    for c, p in edges:
        if c in known and p in known and c not in fixed:
            up.setdefault(c, set()).add(p)
    out = {i: v for i, v in known.items() if i not in up}
    while ready := [c for c in up if c not in out and all(p in out for p in up[c])]:
        for c in ready:
            out[c] = pick(out[p] for p in up[c])
    rest = [c for c in up if c not in out]
    if unresolved is not None:
        return out | dict.fromkeys(rest, unresolved)
    now = out | {c: pick([known[c], *(out[p] for p in up[c] if p in out)]) for c in rest}
    while True:
        new = now | {c: pick([now[c], *(now[p] for p in up[c])]) for c in rest}
        if new == now:
            return now
        now = new


def _check(spark, values, edges, both=True):
    v = spark.createDataFrame(values, "id long, value int, fixed boolean")
    e = spark.createDataFrame(edges, "child long, parent long")
    for combine, pick, unresolved in ((F.min, min, 0), (F.max, max, None)) if both else ((F.min, min, 0),):
        rows = graph.lattice(v, e, combine, unresolved).collect()
        got = {r.id: r.value for r in rows}
        assert len(rows) == len(got) == len(values) and got == _peel(values, edges, pick, unresolved), (values, edges, unresolved)


@pytest.mark.parametrize("seed", range(6))
def test_random_graphs_with_cycles(spark, seed):
    rnd = random.Random(seed)
    n = rnd.choice([6, 14, 30])
    values = [(k, rnd.choice([0, 1, 2, 3] if seed % 2 else [1, 2, 3, 4]), rnd.random() < 0.1) for k in range(n)]
    edges = [(k, rnd.randrange(n) if rnd.random() < 0.15 else rnd.randrange(k + 1)) for k in range(n) for _ in range(rnd.choice([0, 1, 1, 1, 2, 3]))]
    edges += [(n + 5, 1), (1, n + 6), edges[0] if edges else (1, 0)]
    _check(spark, values, edges)


def test_a_cycle_inside_runs_and_nodes_behind_it(spark):
    # 0 -> 1 -> 2 -> 0 is a cycle, 3 and 4 hang below it and below the source 9, 5 to 7 are a run between, 8 joins both
    edges = [(1, 0), (2, 1), (0, 2), (3, 2), (4, 3), (5, 9), (6, 5), (7, 6), (8, 7), (8, 4), (10, 8), (11, 10), (12, 11), (12, 7), (13, 12)]
    _check(spark, [(k, k % 4, False) for k in range(14)], edges)


@pytest.mark.parametrize("unresolved", [0, 7, -1])
def test_other_values_for_the_unresolved(spark, unresolved):
    values, edges = [(k, 1 + k % 3, False) for k in range(9)], [(1, 2), (2, 1), (3, 2), (4, 3), (4, 0), (5, 0), (6, 5), (7, 6), (7, 4), (8, 7)]
    v, e = spark.createDataFrame(values, "id long, value int, fixed boolean"), spark.createDataFrame(edges, "child long, parent long")
    assert {r.id: r.value for r in graph.lattice(v, e, F.min, unresolved).collect()} == _peel(values, edges, min, unresolved)


def test_a_chain_of_1500_takes_few_rounds(spark, monkeypatch):
    n, rounds = 1500, []
    real = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: rounds.append(name) or real(df, name))
    values = [(k, 3 if k else 1, False) for k in range(n)]
    v, e = spark.createDataFrame(values, "id long, value int, fixed boolean"), spark.createDataFrame([(k, k - 1) for k in range(1, n)], "child long, parent long")
    began = time.time()
    out = graph.lattice(v, e, F.min)
    assert {r.id: r.value for r in out.collect()} == dict.fromkeys(range(n), 1)
    assert time.time() - began < 60 and rounds.count("runs") < 30
    assert "Union" not in out._jdf.queryExecution().toString()


def test_ids_of_another_type(spark):
    v, e = spark.createDataFrame([("a", 1, False), ("b", 2, False), ("c", 3, False)], "id string, value int, fixed boolean"), spark.createDataFrame([("b", "a"), ("c", "b")], "child string, parent string")
    assert sorted(map(tuple, graph.lattice(v, e, F.min).collect())) == [("a", 1), ("b", 1), ("c", 1)]


def test_no_nodes(spark):
    _check(spark, [], [])
    _check(spark, [(1, 2, False)], [])
