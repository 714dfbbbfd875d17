"""Valid-time enrichment against a loop over batches."""

import math
import random
import zlib
from datetime import datetime, timedelta

import pytest

from quillgraph.llm import op13_valid_time as op13

START = datetime(2024, 1, 1)


def _micros(t):
    return None if t is None else round((t - datetime(1970, 1, 1)) / timedelta(microseconds=1))


def _loop(sales, changes, batches):
    def number(day):
        return batches - 1 if day is None else min(batches - 1, max(0, (day - 19723) * batches // 152))

    day = lambda t: None if t is None else (t - datetime(1970, 1, 1)).days
    changes = [c for c in {tuple(c) for c in changes} if c[4] is not None]
    cut_s, cut_c = [[] for _ in range(batches)], [[] for _ in range(batches)]
    for s in sales:
        cut_s[number(day(s[2]))].append(s)
    for c in changes:
        at = None if c[0] is None else day(c[4]) + zlib.crc32(str(c[0]).encode()) % 4
        cut_c[number(at)].append(c)
    out, waiting, held, top = [], [], {}, [None, None]
    order = lambda c: (_micros(c[4]), c[2] is not None, c[2] or 0, c[0] is not None, c[0] or 0)

    def emit(sale, b):
        own = sorted(held.get(sale[1], []), key=order) if sale[1] is not None else []
        fit = [c for c in own if sale[3] is not None and c[4] <= sale[3]]
        v = fit[-1] if fit else None
        cents = None if v is None or v[5] is None or math.isnan(v[5]) else math.floor(100 * v[5] + 0.5)
        out.append(("sale", sale[0], b, len(own), v and v[0], cents, v and v[3]))

    for b in range(batches):
        w = [None if t is None else t - timedelta(hours=36) for t in top]
        h = None if None in w else min(w)
        for c in cut_c[b]:
            if w[1] is not None and c[4] < w[1]:
                out.append(("late", c[0], b, None, None, None, None))
            elif c[1] is not None:
                held.setdefault(c[1], []).append(c)
        go, waiting = waiting + cut_s[b], []
        for s in go:
            if s[3] is None or (h is not None and s[3] < h):
                emit(s, b)
            else:
                waiting.append(s)
        for client, own in held.items():
            old = sorted((c for c in own if h is not None and c[4] <= h), key=order)[:-1]
            for c in old:
                own.remove(c)
        for k, rows in ((0, [s[3] for s in cut_s[b]]), (1, [c[4] for c in cut_c[b]])):
            top[k] = max([t for t in [top[k], *rows] if t is not None], default=None)
    for s in waiting:
        emit(s, batches)
    return sorted(map(str, out))


def _frames(spark, sales, changes):
    s = spark.createDataFrame([(*x, "clash") for x in sales], "sale_id long, client_id long, arrived_at timestamp_ntz, sold_at timestamp_ntz, slot string")
    c = spark.createDataFrame(changes, "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, balance double, gate string")
    return s, c


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_loop(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    monkeypatch.setattr(op13, "SPREAD", 4)  # the hot client gets slots of its own
    client = lambda: rnd.choice([7, 7, 7, 1, 2, 3, None])
    when = lambda last: START + timedelta(days=rnd.randrange(last), hours=rnd.choice([0, 0, 5, 12]), microseconds=rnd.choice([0, 1]))
    sales = []
    for n in range(220):
        sold = rnd.choice([None, *[when(60)] * 9])
        arrived = rnd.choice([None, START - timedelta(days=3), *[(sold or when(60)) + timedelta(days=rnd.choice([0, 0, 1, 9]))] * 20])
        sales.append((n % 200 if n % 50 else None, client(), arrived, sold))
    sales += sales[:3]
    changes = [(rnd.choice([None, n]), client(), rnd.choice([None, 0, 1]), rnd.choice("IUD"), rnd.choice([None, *[when(60)] * 9]), rnd.choice([None, math.nan, 1.005, -2.5, 100.0]), "x") for n in range(150)]
    changes += [*changes[:9], (5, 7, 0, "U", START, 1.0, "one"), (5, 7, 0, "U", START, 1.0, "two")]
    s, c = _frames(spark, sales, changes)
    # NaN is not equal to itself in Python, so equal rows are told by their text there
    want = _loop(sales, [tuple(x) for x in {str(x): x for x in changes}.values()], 5)
    out = op13.enrich_batches(s, c, batches=5, slots=6)
    assert sorted(str(tuple(r)) for r in out.collect()) == want
    assert len(op13._hot_clients(s, 6)) == 1


def test_empty_tables(spark):
    s, c = _frames(spark, [(1, 7, START, START)], [(1, 7, 0, "U", START, 1.0, "x")])
    assert op13.enrich_batches(s.limit(0), c.limit(0), batches=2, slots=2).count() == 0
    assert [tuple(r) for r in op13.enrich_batches(s, c.limit(0), batches=2, slots=2).collect()] == [("sale", 1, 2, 0, None, None, None)]


def test_a_start_loads_one_store_a_partition(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op13, "shared_path", lambda spark, name: f"file://{tmp_path}/{name}")
    s, c = _frames(spark, [(1, 7, START, START)], [(1, 7, 0, "U", START, 1.0, "x")])
    assert [tuple(r) for r in op13.enrich_batches(s, c, batches=2, slots=2).collect()] == [("sale", 1, 2, 1, 1, 100, "U")]
    assert [p.name for p in (tmp_path / "op13/checkpoint/state").iterdir() if p.name.isdigit()] == ["0"]


def test_slots_go_by_rows_where_partitions_are_many():
    assert op13.slots_for(500_000, 211) == 250 and op13.slots_for(500_000, 12) == 48 and op13.slots_for(2_500_000, 12) == 125 and op13.slots_for(0, 12) == 1
