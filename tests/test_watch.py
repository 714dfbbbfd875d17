"""Streams with timers against their batch twins."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quillgraph.shared import shared_path
from quillgraph.streaming import sessions, watch

DAY = datetime(2024, 1, 1)


def _run(spark, frames, make):
    folder, state, out = shared_path(spark, "events"), shared_path(spark, "state"), []
    with watch.state_store(spark):
        for df in frames:
            df.write.mode("append").parquet(folder)
            out += sessions.run(make(sessions.file_stream(spark, folder, "*.parquet", df.schema)), "append", state).collect()
    return out


def test_a_burst_acts_once_it_has_settled(spark):
    at = lambda s: DAY + timedelta(seconds=s)
    rows = [
        [("a", at(0), 1, "x"), ("a", at(5), 2, "y"), ("b", at(6), 3, "x"), (None, at(7), 4, "x"), ("a", None, 5, "z")],
        [("b", at(8), 6, None), ("a", at(4), 7, "out of order"), ("c", at(60), 8, "k")],
        [("a", at(100), 9, "y"), ("c", at(101), 10, None), ("c", at(101), 11, None), ("b", at(102), 12, "back")],
        [("d", at(300), 13, "waits")],
    ]
    frames = [spark.createDataFrame(r, "path string, ts timestamp, n long, hash string") for r in rows]
    got = sorted((r.path, r.at, r.action, r.hash) for r in _run(spark, frames, lambda s: watch.watch(s, 10, "20 seconds")))
    # b was written and removed within one burst: nothing happened; a was written again with the same content
    assert got == [("a", at(5), "create", "y"), ("b", at(102), "create", "back"), ("c", at(60), "create", "k"), ("c", at(101), "prune", None)]


def test_the_stream_equals_the_table(spark):
    rnd = random.Random(3)
    rows = sorted((rnd.choice("abcd"), DAY + timedelta(seconds=rnd.randrange(4000)), n, rnd.choice([None, "x", "x", "y"])) for n in range(300))
    rows.sort(key=lambda r: (r[1], r[2]))
    frames = [spark.createDataFrame(rows[k : k + 75], "path string, ts timestamp, n long, hash string") for k in range(0, 300, 75)]
    got = sorted(map(str, _run(spark, frames, lambda s: watch.watch(s, 40, "1 second"))))
    whole = spark.createDataFrame(rows, frames[0].schema)
    assert got == sorted(map(str, watch.settled(whole, 40, F.lit(rows[-1][1] - timedelta(seconds=1))).collect())) and len(got) > 10


def test_first_seen_pins_and_counters(spark):
    rows = [[("t", DAY, 1, "p"), ("t", DAY, 2, "p"), ("u", DAY, 3, "q")], [("t", DAY + timedelta(1), 5, "other"), ("t", DAY + timedelta(1), 4, "p"), (None, DAY, 6, "p"), ("u", DAY, 7, None)]]
    frames = [spark.createDataFrame(r, "tool string, ts timestamp, n long, hash string") for r in rows]
    assert [tuple(r) for r in _run(spark, frames, watch.pin_calls)] == [("t", 5, "p", "other", 4)]
