"""Threshold sweeps and canonical JSON."""

import json
import math
import random

from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import scoring


def test_sweep_equals_counting(spark):
    rnd = random.Random(1)
    scores = [rnd.choice([None, math.nan, 0.0, 0.1, 0.3, 0.7, 1.0, 1.5, -0.2, -3.0, rnd.random()]) for _ in range(500)]
    got = {r.floor: r for r in scoring.threshold_sweep(spark.createDataFrame([(x, "clash") for x in scores], "score double, passed string")).collect()}
    good = [x for x in scores if x is not None and not math.isnan(x)]
    assert len(got) == 11
    for k in range(11):
        row = got[k / 10]
        assert row.hits == sum(x >= k / 10 for x in good) and row.would_inject_rate == round(row.hits / 500, 3)
        assert row.bin_n == (sum(min(9, max(0, int(x * 10))) == k for x in good) if k < 10 else None)
    assert got[0.2].bin == "0.2-0.3"
    none = scoring.threshold_sweep(spark.createDataFrame([], "score double")).collect()
    assert len(none) == 11 and {(r.hits, r.would_inject_rate) for r in none} == {(0, 0.0)}


def test_canonical_json(spark):
    rnd = random.Random(2)

    def value(depth):
        kind = rnd.choice(["n", "s", "b"] if depth > 2 else ["n", "s", "b", "l", "o", "o"])
        return {"n": lambda: rnd.randint(-5, 5), "s": lambda: rnd.choice(["", "x y", "é", '"q"']), "b": lambda: rnd.choice([True, False, None]), "l": lambda: [value(depth + 1) for _ in range(3)], "o": lambda: {k: value(depth + 1) for k in rnd.sample("abcdef", 3)}}[kind]()

    def shuffled(x):
        if isinstance(x, dict):
            return {k: shuffled(x[k]) for k in rnd.sample(list(x), len(x))}
        return [shuffled(y) for y in x] if isinstance(x, list) else x

    rows = []
    for n in range(60):
        x = {"top": value(0)}
        rows += [(n, json.dumps(shuffled(x), indent=rnd.choice([None, 2]), ensure_ascii=rnd.random() < 0.5)) for _ in range(4)]
    df = spark.createDataFrame(rows, "n int, t string").groupBy("n").agg(F.count_distinct(T.canonical_json(F.col("t"))).alias("d"))
    assert {r.d for r in df.collect()} == {1}
    odd = ['{"a": 1}', '{"a": 1.5}', '{"a": "1"}', '{"a": true}', "no json", '{"a": 1, "a": 2}', None]
    assert len({r[0] for r in spark.createDataFrame([(x,) for x in odd], "t string").select(T.canonical_json(F.col("t"))).collect()}) == len(odd)
