"""As-of joins by row and references to facts, against plain loops."""

import random
from datetime import datetime, timedelta

import pytest

from quillgraph.operators import asof

DAY = datetime(2024, 1, 1)


@pytest.mark.parametrize(("seed", "ranges", "first"), [(1, 1, False), (2, 7, False), (3, 16, True), (4, 5, True)])
def test_each_probe_has_its_own_time(spark, seed, ranges, first):
    rnd = random.Random(seed)
    # one key holds most rows, so it spans many ranges
    key = lambda: rnd.choice([0, 0, 0, 0, 1, 2, None, 9])
    time = lambda: rnd.choice([None, *(DAY + timedelta(hours=rnd.randrange(60)) for _ in range(9))])
    facts = [(key(), time(), rnd.choice([None, 1, 2]), n) for n in range(300)]
    probes = [(key(), time(), n % 50, "clash") for n in range(400)]
    probes += probes[:5]
    f = spark.createDataFrame(facts, "k int, at timestamp, seq int, id int")
    p = spark.createDataFrame(probes, "k int, t timestamp, id int, fact string")
    got = asof.asof_join(p, f, "k", "t", "at", ("seq", "id"), first, "found", ranges).collect()

    def plain(k, t):
        own = sorted((x for x in facts if x[0] == k and x[1] is not None), key=lambda x: (x[1], x[2] if x[2] is not None else -1, x[3]))
        if k is None or t is None or not own:
            return None
        before = [x for x in own if x[1] <= t]
        return before[-1][3] if before else own[0][3] if first else None

    show = lambda k, t, i, f, x: (str(k), str(t), i, f, str(x))
    assert sorted(show(r.k, r.t, r.id, r.fact, r.found and r.found.id) for r in got) == sorted(show(*x, plain(x[0], x[1])) for x in probes)


def test_as_of_with_an_empty_side(spark):
    f, p = spark.createDataFrame([], "k int, at timestamp"), spark.createDataFrame([(1, DAY)], "k int, t timestamp")
    assert [tuple(r) for r in asof.asof_join(p, f, "k", "t", "at").collect()] == [(1, DAY, None)]
    assert asof.asof_join(p.limit(0), p.withColumnRenamed("t", "at"), "k", "t", "at").count() == 0


def test_no_window_holds_a_whole_key(spark):
    f, p = spark.range(10).selectExpr("0 k", "timestamp_seconds(id) at"), spark.range(10).selectExpr("0 k", "timestamp_seconds(id) t")
    plan = asof.asof_join(p, f, "k", "t", "at")._jdf.queryExecution().optimizedPlan().toString()
    assert all("range#" in line for line in plan.splitlines() if "windowspecdefinition" in line)


def test_references_in_texts(spark):
    versions = [("fact_a", 1, "10", "usd", DAY, 1, DAY, ""), ("fact_a", 2, "20", "usd", DAY + timedelta(9), 0, None, None), ("fact_r", 3, "7", None, DAY, 1, DAY + timedelta(3), " moved "), ("fact_s", 4, "8", "", DAY, 1, None, asof.SWEPT), ("fact_e", 5, None, "kg", DAY, 0, None, None)]
    texts = [
        (1, "[[fact_a]] and [[fact_a]], [[fact_r]]", DAY + timedelta(1)), (2, "[[fact_a]]", DAY + timedelta(9)), (3, "early [[fact_a]]!", DAY - timedelta(1)), (4, "[[fact_s]] [[fact_e]] [[fact_x]] [[note]]", DAY),
        (5, "no time [[fact_a]]", None), (6, None, DAY), (7, "", DAY), (8, "plain", DAY), (8, "[[fact_r]]", DAY), (None, "[[fact_a]][[fact_a]]", DAY + timedelta(20)),
    ]
    got = asof.resolve_references(spark.createDataFrame(texts, "id int, text string, as_of timestamp"), spark.createDataFrame(versions, "stem string, nid int, value string, unit string, created_at timestamp, tombstoned int, tombstoned_at timestamp, reason string")).collect()
    was = "20 usd (was 10 usd when written, {})"
    gone = "7 (last known — fact retired 2024-01-04: moved)"
    want = [(1, f"{was.format('2024-01-02')} and {was.format('2024-01-02')}, {gone}"), (2, "20 usd"), (3, f"early {was.format('2023-12-31')}!"), (4, "8 (last known — fact retired) [[fact_e]] [[fact_x]] [[note]]"),
            (5, "no time 20 usd"), (6, None), (7, ""), (8, "plain"), (8, gone), (None, "20 usd20 usd")]
    assert sorted(map(str, ((r.id, r.text) for r in got))) == sorted(map(str, want))
