"""Explained ancestries against a depth-first walk."""

import random

import pytest

from quillgraph.operators import graph


def _walk(edges, seed):
    up = {}
    for c, p in edges:
        up.setdefault(c, set()).add(p)
    out, seen = [(0, seed, False)], {seed}

    def visit(node, depth):
        for p in sorted(up.get(node, ())):
            out.append((depth, p, p in seen))
            if p not in seen:
                seen.add(p)
                visit(p, depth + 1)

    visit(seed, 1)
    return [(seed, n + 1, *row) for n, row in enumerate(out)]


@pytest.mark.parametrize("seed", range(5))
def test_explain_is_a_depth_first_walk(spark, seed):
    rnd = random.Random(seed)
    n = 14
    edges = [(rnd.randrange(n), rnd.randrange(n)) if seed > 2 else tuple(sorted(rnd.sample(range(n), 2), reverse=True)) for _ in range(22)]
    edges += edges[:2] + [(None, 1), (3, None)]
    seeds = [(0,), (n - 1,), (5,), (5,), (99,), (None,)]
    got = graph.explain_tree(spark.createDataFrame(edges, "child long, parent long"), spark.createDataFrame(seeds, "id long")).collect()
    real = [e for e in edges if None not in e]
    assert sorted(map(tuple, got)) == sorted(row for s in (0, n - 1, 5, 99) for row in _walk(real, s))
