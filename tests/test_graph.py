import random

from pyspark.sql import functions as F

from quillgraph.operators import graph
from quillgraph.operators.components import connected_components


def _edges(spark, pairs, names="child long, parent long"):
    return spark.createDataFrame(pairs, names)


def _up(pairs, seed):
    seen, todo = set(), [seed]
    while todo:
        x = todo.pop()
        for c, p in pairs:
            if c == x and p not in seen:
                seen.add(p)
                todo.append(p)
    return seen


def test_closure_random_graphs_with_cycles(spark):
    rnd = random.Random(5)
    pairs = [(rnd.randrange(15), rnd.randrange(15)) for _ in range(24)]
    seeds = spark.createDataFrame([(k,) for k in range(15)], "id long")
    got = {(r.seed, r.id) for r in graph.closure(_edges(spark, pairs), seeds, "child", "parent", include_seed=False).collect()}
    assert got == {(s, x) for s in range(15) for x in _up(pairs, s)}
    down = {r.id for r in graph.reachable(_edges(spark, pairs), seeds.where("id = 3")).collect()}
    assert down == {3} | _up([(p, c) for c, p in pairs], 3)


def test_lattice_diamond_cycle_and_orphan(spark):
    # 10 <- 1, 2; 11 <- 10, 3; 12 <-> 13 cycle; 14 <- 12; 15 has no parent
    values = spark.createDataFrame([(1, 3, True), (2, 2, True), (3, 0, True), (10, 1, False), (11, 1, False), (12, 1, False), (13, 1, False), (14, 1, False), (15, 1, False)], "id long, value int, fixed boolean")
    edges = _edges(spark, [(10, 1), (10, 2), (11, 10), (11, 3), (12, 13), (13, 12), (14, 12)])
    got = {r.id: r.value for r in graph.lattice(values, edges, F.min).collect()}
    assert got == {1: 3, 2: 2, 3: 0, 10: 2, 11: 0, 12: 0, 13: 0, 14: 0, 15: 1}


def test_widest_path_diamond_and_levels(spark):
    nodes = spark.createDataFrame([(0, 3, True), (1, 0, True), (2, 2, True), (3, 3, True), (4, 3, False)], "id long, label int, conducts boolean")
    rel = _edges(spark, [(0, 1), (1, 3), (0, 2), (2, 3), (0, 4)], "a long, b long")
    got = {(r.id, r.hop, r.path_min) for r in graph.neighborhood(nodes, rel, spark.createDataFrame([(0,)], "id long"), 2).collect()}
    assert got == {(1, 1, 0), (2, 1, 2), (3, 2, 2)}


def test_three_hops_are_level_synchronous(spark):
    labels = {0: 3, 1: 1, 2: 1, 3: 3, 4: 3, 5: 0}
    nodes = spark.createDataFrame([(k, v, True) for k, v in labels.items()], "id long, label int, conducts boolean")
    rel = _edges(spark, [(0, 4), (0, 5), (1, 2), (2, 3), (2, 5), (3, 4), (3, 5)], "a long, b long")
    got = {r.id: r.path_min for r in graph.neighborhood(nodes, rel, spark.createDataFrame([(0,)], "id long"), 3).collect()}
    assert got[1] == 0


def _walk(links, x):
    """The last node of a walk that is new to it."""
    seen = {x}
    while x in links and links[x] not in seen:
        x = links[x]
        seen.add(x)
    return x


def test_heads_chain_and_cycle(spark):
    rnd = random.Random(3)
    links = {k: k + 1 for k in range(40)} | {100: 101, 101: 100, 200: 200, 201: 200, 1: 5, 5: 6, 6: 5, 50: 1} | {300 + k: 300 + rnd.randrange(30) for k in range(30)}
    got = {r.id: r["head"] for r in graph.heads(_edges(spark, list(links.items()), "id long, next long")).collect()}
    assert got == {k: _walk(links, k) for k in links} and (got[1], got[5], got[6]) == (6, 6, 5)
    assert graph.heads(_edges(spark, [], "id long, next long")).count() == 0


def test_confidentiality_of_a_cycle_is_its_fixpoint(spark):
    values = spark.createDataFrame([(1, 2, True), (2, 0, True), (10, 0, False), (11, 1, False), (12, 0, False), (20, 1, False), (21, 0, False)], "id long, value int, fixed boolean")
    edges = _edges(spark, [(10, 11), (11, 10), (11, 2), (12, 10), (20, 21), (21, 20), (21, 1)])
    got = {r.id: r.value for r in graph.lattice(values, edges, F.max, unresolved=None).collect()}
    assert got == {1: 2, 2: 0, 10: 1, 11: 1, 12: 1, 20: 2, 21: 2}



def test_components_random(spark):
    rnd = random.Random(9)
    pairs = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(200 + k, 201 + k) for k in range(30)]
    root = list(range(300))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in connected_components(_edges(spark, pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in pairs if a != b for x in (a, b)}


def test_components_of_nothing(spark):
    assert connected_components(_edges(spark, [], "a long, b long")).count() == 0


def _rounds(monkeypatch):
    """Counts what the graph operators write."""
    written = []
    plain = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: (written.append(name), plain(df, name))[1])
    return written


def test_a_long_chain_is_closed_in_few_rounds(spark, monkeypatch):
    n = 150
    written = _rounds(monkeypatch)
    pairs = [(k + 1, k) for k in range(n)] + [(k, 1000 + k % 7) for k in range(n)] + [(500, 501), (501, 500), (502, n)]
    edges = _edges(spark, pairs)
    got = {(r.seed, r.id): r.depth for r in graph.distances(edges, None, "child", "parent").collect()}
    assert got.keys() == {(s, x) for s in {c for c, _ in pairs} for x in _up(pairs, s)}
    assert all(got[a, b] == a - b for a in range(1, n + 1) for b in range(a)) and got[500, 500] == 2
    assert {r.depth for r in graph.distances(edges, None, "child", "parent", most=40).where("seed = 150 and id < 150").collect()} == set(range(1, 41))
    assert len(written) <= 40
    written.clear()
    edges = _edges(spark, [*pairs, (None, 140), (None, 141)])
    down = sorted((r.id for r in graph.reachable(edges, spark.createDataFrame([(3,), (900,)], "id long")).collect()), key=lambda x: x or -1)
    assert down == sorted([None, 502, 900, *range(3, n + 1)], key=lambda x: x or -1)
    assert len(written) <= 60
