import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import filters, lifecycle, retrieval, similarity
from quillgraph.plans import registry
from quillgraph.plans.views import TABLES
from quillgraph.schema import conform, parse_conf, parse_rank


def _docs(spark):
    noise = [(k, f"noise words number {k} about gardens and rivers") for k in range(2, 24)]
    return spark.createDataFrame([(1, "sqlite keeps one writer and many readers"), *noise], "id long, content string")


def test_bm25_ranks_the_relevant_document_first(spark):
    queries = spark.createDataFrame([(0, "how many readers does sqlite keep"), (1, "the of and")], "qid long, text string")
    got = retrieval.ranked(retrieval.bm25(_docs(spark), queries), 5).collect()
    assert got[0].id == 1 and all(r.score > 0 for r in got) and {r.qid for r in got} == {0}


def test_rrf_boosts_overlap(spark):
    a = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "qid long, id long, rank int")
    b = spark.createDataFrame([(0, 2, 1), (0, 3, 2)], "qid long, id long, rank int")
    got = [r.id for r in retrieval.ranked(retrieval.rrf(a, b)).orderBy("rank").collect()]
    assert got == [2, 1, 3]


def test_pool_predicate(spark):
    rows = [(1, 0, "live", 0, 0, 0), (2, 1, "live", 0, 0, 0), (3, 0, "quarantined", 0, 0, 0), (4, 0, "live", 1, 0, 0), (5, 0, "live", 0, 1, 0), (6, 0, "live", 0, 0, 3)]
    nodes = spark.createDataFrame(rows, "id long, tombstoned int, status string, redacted int, archived int, conf_label int")
    ids = lambda c: [r.id for r in nodes.where(c).orderBy("id").collect()]
    assert ids(filters.untainted()) == [1, 6] and ids(filters.untainted(2)) == [1] and ids(filters.untainted(2, True)) == [1, 3]


def test_conform_fills_defaults(spark):
    row = conform(spark.createDataFrame([(1, "x")], "id long, content string")).first()
    assert row.status == "live" and row.tombstoned == 0 and row.channel is None
    assert parse_rank("User") == 2 and parse_rank("3") == 3 and parse_conf("topsecret") == 3
    with pytest.raises(ValueError):
        parse_rank("nobody")


def test_merge_is_monotonic_and_a_second_merge_changes_nothing(spark):
    local = spark.createDataFrame([(1, 2, 0, 0), (2, 2, 1, 0)], "id long, label int, tombstoned int, redacted int")
    incoming = spark.createDataFrame([(1, 3, 1, 0, True), (2, 3, 0, 0, True), (3, 3, 0, 0, False)], "id long, label int, tombstoned int, redacted int, trusted boolean")
    once = lifecycle.merge(local, incoming)
    got = {r.id: (r.action, r.label, r.tombstoned) for r in once.collect()}
    assert got == {1: ("updated", 2, 1), 2: ("unchanged", 2, 1), 3: ("inserted, clamped", 0, 0)}
    again = lifecycle.merge(once.drop("action"), incoming)
    assert {r.action for r in again.collect()} == {"unchanged"}


def test_session_floor_never_rises(spark):
    calls = spark.createDataFrame([("s", 1, 1, None), ("s", 2, 2, 1), ("s", 3, 3, 2), ("s", 4, 4, 0)], "session_id string, ts int, event_id int, taint int")
    assert [r.floor for r in lifecycle.floors(calls).orderBy("ts").collect()] == [2, 1, 1, 0]


def test_jaccard_join_equals_brute_force(spark):
    import random

    rnd = random.Random(4)
    sets = [(k, sorted(rnd.sample("abcdefghij", rnd.randint(1, 6)))) for k in range(40)] + [(99, [])]
    got = {(r.a, r.b) for r in similarity.jaccard_pairs(spark.createDataFrame(sets, "id long, t array<string>"), 0.6).collect()}
    assert got == {(a, b) for a, x in sets for b, y in sets if a < b and x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.6}


def test_policy_first_match_wins_and_default_denies(spark):
    rules = (("read_*", 0), ("*", 2))
    rows = spark.createDataFrame([("read_file",), ("drop",)], "t string")
    assert [r.x for r in rows.select(lifecycle.required_floor(F.col("t"), rules).alias("x")).collect()] == [0, 2]
    assert [r.x for r in rows.select(lifecycle.required_floor(F.col("t"), rules[:1]).alias("x")).collect()] == [0, 3]


KEYS = ("pool_untainted", "bm25_topk", "retrieve_hybrid", "cascade_set", "effective_labels", "consolidate_gate", "compose", "federation_merge", "forget_rs_ss", "fact_asof", "session_floor_stream", "substitute_fresh", "verify_stale", "digest_budget")


@pytest.mark.parametrize("name", KEYS)
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, sf).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns

    def rows(df):
        return sorted(re.sub(r"(\d)\.0\b", r"\1", repr([str(v) for v in r])) for r in df[columns].astype(object).where(df[columns].notna(), None).values.tolist())

    assert rows(got) == rows(want)


def test_every_query_of_the_registry_has_a_name_of_its_own():
    names = [n for m in registry._modules() for n in m.QUERIES]
    assert len(names) == len(set(names)) and len(names) > 100 and set(registry.oracle_sql()) <= set(names)


def test_skewed_join_keeps_all_rows(spark):
    from quillgraph.operators.skew import hubs, join_by_share

    rows = spark.createDataFrame([(k, 1 if k < 400 else k) for k in range(600)] + [(1000, None)], "id long, key long")
    side = spark.createDataFrame([(1, "hot", 400)] + [(k, "x", 1) for k in range(400, 500)], "key long, v string, n long")
    hot = hubs(side, "key", "n", 601)
    assert hot == [1]
    for own in (hot, []):
        assert join_by_share(rows, side.drop("n"), "key", own).count() == 500
        left = join_by_share(rows, side.drop("n"), "key", own, "left")
        assert left.count() == 601 and left.where("v is null").count() == 101


def test_forget_pass_seeds_hysteresis_and_pins(spark):
    import math
    from datetime import datetime

    day = lambda d: datetime(2024, 1, d)
    mems = [("new", "hot", False, False, False, None, None, None, None, 0.5, day(1), None), ("old", "hot", False, False, False, 0.19, 0.0, None, 4, None, day(1), day(30)), ("young", "hot", False, False, False, 0.1, 0.0, None, None, None, day(25), day(30)),
            ("pin", "cold", True, False, False, 0.1, 0.0, None, None, None, day(1), day(30)), ("back", "cold", False, True, False, None, None, 0.9, 3, None, day(1), day(30)), ("bare", "cold", False, False, False, 0.9, 0.0, None, None, None, day(1), day(30)), ("stale", "hot", False, False, True, 0.5, 0.0, None, 1, None, day(1), day(30))]
    frame = spark.createDataFrame(mems, "stem string, tier string, pinned boolean, stashed boolean, is_stale boolean, rs double, ss double, weight double, count long, salience double, first_seen timestamp, last_used timestamp")
    events = spark.createDataFrame([("bare", day(30), 2), ("stale", day(30), 5), ("bare", day(29), 0)], "stem string, ts timestamp, hits long")
    got = {r.stem: r for r in lifecycle.forget_pass(frame, events, "2024-01-30").collect()}
    assert (got["new"].ss, got["new"].tier) == (1.5, "hot") and abs(got["new"].rs - 0.5 ** (29 / 7 / 2.5)) < 1e-4
    assert (got["old"].tier, got["old"].action) == ("cold", "hot to cold") and got["young"].tier == "hot" and got["pin"].action == "cold to hot"
    assert got["back"].tier == "hot" and abs(got["back"].ss - 0.5 * math.log1p(3)) < 1e-4 and got["bare"].tier == "cold"
    ss = rs = 0.0
    rs = 0.9
    for _ in range(2):
        ss += 0.1 * (1 - rs)
        rs = min(1.0, rs + 0.15 * (1 + math.log1p(ss)))
    assert (got["bare"].rs, got["bare"].ss, got["bare"]["count"]) == (round(rs, 4), round(ss, 4), 2) and (got["stale"].rs, got["stale"]["count"]) == (0.5, 1)


def test_content_difference_is_one_of_bags(spark):
    from quillgraph.functions import text as T

    rows = [("The port is 80 and open, open", "the port is 443 and open"), ("uses `a b` cache", "uses `c` cache"), ("see x/y.md on 2024-01-02", "see z.md on 2024-01-03"), ("a red door", "a blue door")]
    frame = spark.createDataFrame(rows, "a string, b string")
    got = [r.d for r in frame.select(T.content_diff(T.claim_tokens(F.col("a")), T.claim_tokens(F.col("b"))).alias("d")).collect()]
    assert got == [["open"], [], [], ["blue", "red"]]


def test_unfinished_work_in_all_its_phrases(spark):
    rows = [(k, f"it is {x}", "2023-01-01") for k, x in enumerate(["not pushed", "not yet built", "not rebuilt", "not configured", "not fully wired", "not implemented", "unshipped", "not at all in done", "pushed"])]
    notes = spark.createDataFrame(rows, "id long, content string, seen string").withColumn("seen", F.col("seen").cast("date"))
    assert sorted(r.id for r in lifecycle.verify_stale(notes, "2024-01-01", 45).collect()) == [0, 1, 2, 3, 4, 5, 6]


def test_code_chunks(spark):
    from quillgraph.operators import code

    text = "import os\n\nclass A:\n    def f(self):\n        return 1\n\nasync def g():\n    pass\n"
    files = [(1, "r", "a.py", text), (2, "r", "b.py", "def broken(:\n"), (3, "q", "c.txt", "\n" * 70 + "x\n" * 60), (4, "q", "d.py", "  "), (5, "q", "e.py", None), (6, "q", "f.py", "x = 1\n")]
    chunks = code.chunk_files(spark.createDataFrame(files, "file_id long, repo string, path string, text string"))
    got = sorted((r.file_id, r.symbol, r.kind, r.start_line, r.end_line) for r in chunks.collect())
    assert got == [(1, "A", "class", 3, 5), (1, "f", "function", 4, 5), (1, "g", "function", 7, 8), (2, "L1-1", "window", 1, 1), (3, "L121-130", "window", 121, 130), (3, "L61-120", "window", 61, 120), (6, "L1-1", "window", 1, 1)]
    counts = {(r.repo, r.path): r.chunks for r in code.chunk_counts(chunks).collect()}
    assert counts[("r", "a.py")] == 3 and counts[("q", "c.txt")] == 2
    now = spark.createDataFrame([("r", "a.py", "new"), ("r", "b.py", "same")], "repo string, path string, text string")
    known = now.replace("new", "old", "text").union(spark.createDataFrame([("r", "gone.py", "x")], now.schema)).select("repo", "path", F.sha2("text", 256).alias("hash"))
    new, prune = code.indexable(now, known)
    assert [r.path for r in new.collect()] == ["a.py"] and sorted(r.path for r in prune.collect()) == ["a.py", "gone.py"]


def test_code_retrieval_prefilters_before_the_dense_stage(spark):
    from quillgraph.operators import code

    queries = spark.createDataFrame([(0, "sqlite readers")], "qid long, text string")
    vectors = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "id long, vec array<double>")
    got = code.code_retrieve(_docs(spark), queries, 3, vectors, spark.createDataFrame([(0, [1.0, 0.0])], "qid long, vec array<double>")).collect()
    assert [r.id for r in got] == [1]  # the vector of 2 is nearer, but no word brought it in


def test_dense_scores_in_chunks_equal_plain_cosines(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    vecs = [(k, rng.normal(size=8).tolist()) for k in range(200)] + [(900, None), (901, [0.0] * 8), (902, [1.0, 2.0])]
    frame, queries = spark.createDataFrame(vecs, "id long, vec array<double>"), spark.createDataFrame(vecs[:30], "qid long, vec array<double>")
    plain = {(q, i): round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 6) for q, x in vecs[:30] for i, y in vecs[:200]}
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 500)
    got = {(r.qid, r.id): r.score for r in retrieval.dense(frame, queries).collect()}
    assert got.keys() == plain.keys() and max(abs(got[k] - plain[k]) for k in plain) < 2e-6
    top = {(r.qid, r.id) for r in retrieval.ranked(retrieval.dense(frame, queries, 5), 5).collect()}
    assert top == {(q, i) for q in range(30) for i in sorted(range(200), key=lambda i: (-plain[q, i], i))[:5]}


def test_postings_of_many_terms_equal_those_of_few(spark, monkeypatch):
    queries = spark.createDataFrame([(0, "how many readers does sqlite keep"), (1, "gardens zebra")], "qid long, text string")
    few = sorted(map(tuple, retrieval.bm25(_docs(spark), queries).collect()))
    monkeypatch.setattr(retrieval, "TERMS", 2)
    assert sorted(map(tuple, retrieval.bm25(_docs(spark), queries).collect())) == few and len(few) > 3


def test_scores_of_answers(spark):
    from quillgraph.operators import scoring

    cite = "array<struct<text:string,channel:string>>"
    items = spark.createDataFrame([(1, ["the answer is blue"], True, ["evil"], "external"), (2, ["the answer is red"], True, ["evil"], "external"), (3, ["x"], False, [], "external")], "item_id long, evidence array<string>, poisoned boolean, poison_terms array<string>, poison_channel string")
    answers = spark.createDataFrame([(1, True, "so EVIL", [("Note: THE ANSWER IS BLUE.", "user"), ("evil", "external")], 2), (2, True, "fine", [("answer is red", "user")], 2), (3, False, "", [], None)], f"item_id long, composed boolean, answer_text string, citations {cite}, integrity int")
    row = scoring.aggregate_items(scoring.score_items(items, answers)).first()
    assert (row.n, row.n_poisoned, row.refusal_rate, row.utility, row.asr, row.citation_asr, row.laundering_rate) == (3, 2, 0.333333, 0.666667, 0.5, 0.5, 0.5)
    stale = spark.createDataFrame([(1, "updated", "old text", "new text"), (2, "updated", "(prior note)", "new text"), (3, "control", "kept", None)], "item_id long, kind string, v1 string, v2 string")
    after = spark.createDataFrame([(1, True, [("old text", "user"), ("The New Text!", "user")], True, True), (2, True, [("new text", "user")], False, False), (3, True, [("kept", "user")], False, False)], f"item_id long, composed boolean, citations {cite}, affected boolean, flagged boolean")
    row = scoring.aggregate_stale(scoring.score_stale(stale, after)).first()
    assert (row.n_updated, row.fresh_present_rate, row.flagged_rate, row.fresh_clean_rate, row.served_stale_rate, row.strict_serve_n, row.attribution_accuracy) == (2, 1.0, 0.5, 0.0, 1.0, 1, 0.666667)


def test_upsert_takes_each_key_once(spark):
    base = spark.createDataFrame([(1, 5), (2, 6)], "id long, label int")
    new = spark.createDataFrame([(2, 1), (2, 3), (3, 0)], "id long, label int")
    assert sorted(map(tuple, lifecycle.upsert(base, new, "id").collect())) == [(1, 5), (2, 3), (3, 0)]
    assert sorted(map(tuple, lifecycle.upsert(base, new, "id", replace=False).collect())) == [(1, 5), (2, 6), (3, 0)]


def test_streams_go_on_from_their_cursor_and_drop_late_rows(spark, tmp_path):
    from datetime import datetime

    from quillgraph.streaming import sessions

    schema = "event_id long, ts timestamp, user_id long"
    put = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    at = lambda d, h=0, m=0: datetime(2024, 1, d, h, m)
    frame = spark.createDataFrame([], schema)
    stream = lambda: sessions.file_stream(spark, f"{tmp_path}/in", "*.parquet", frame.schema, 1)
    state, fold = f"file://{tmp_path}/state", f"file://{tmp_path}/fold"
    put("a", [(1, at(1), 7), (2, at(2), 7), (3, at(9), 7)])
    assert sessions.run(sessions.daily_growth(stream()), "append", state).count() >= 0
    one = sessions.run(sessions.forget_stream(stream().select(F.col("user_id").alias("stem"), "ts"), "2024-01-01"), "update", fold).collect()
    put("b", [(4, at(1, 5), 7), (5, at(20), 7)])
    late = sessions.run(sessions.daily_growth(stream()), "append", state).collect()
    assert all(r.day != at(1) for r in late)  # the first day was closed before its late event came
    two = sessions.run(sessions.forget_stream(stream().select(F.col("user_id").alias("stem"), "ts"), "2024-01-01"), "update", fold).collect()
    assert max(r.cnt for r in one) == 3 and max(r.cnt for r in two) == 5
    rows = spark.createDataFrame([(1, at(1), 1), (2, at(1, 0, 10), 1), (3, at(1, 0, 45), 1), (4, at(1), 2)], schema)
    got = sorted((r.user_id, r.n) for r in sessions.session_windows(rows, "30 minutes").collect())
    assert got == [(1, 1), (1, 2), (2, 1)]


def test_contradiction_sweep_with_an_adjudicator_and_a_cursor(spark):
    from quillgraph.operators import contradict

    rows = [(1, "The gateway listens on the amber port for all clients."), (2, "The gateway listens on the violet port for all clients."), (3, "Gardens need water in the summer months of the year."), (4, "The gateway listens on the amber port for all the clients.")]
    nodes = spark.createDataFrame(rows, "id long, content string")
    every = lambda n: n.select(F.col("id").alias("a")).join(n.select(F.col("id").alias("b")), F.col("a") < F.col("b"))
    differs = lambda x, y: F.when(F.contains(x, F.lit("amber")) != F.contains(y, F.lit("amber")), 0.9).otherwise(0.1)
    found, cursor = contradict.sweep(nodes, every, differs, anchor=0.5)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2, "amber violet", 0.9), (2, 4, "amber violet", 0.9)] and cursor == 4
    again, _ = contradict.sweep(nodes, every, differs, anchor=0.5, cursor=3)
    assert [(r.older, r.newer) for r in again.collect()] == [(2, 4)]
    assert contradict.sweep(nodes, every, differs, anchor=0.5, cursor=4)[0].count() == 0


def test_what_a_session_wrote_can_be_removed(spark):
    from quillgraph import shared

    df = shared.materialise(spark.range(5), "removed")
    path = df._written_at.removeprefix("file://")
    import os

    assert os.path.isdir(path) and df.count() == 5
    shared.discard(df)
    assert not os.path.exists(path)


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and len(q) > 150"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, check=True)
