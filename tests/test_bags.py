"""Bags of stems against the column functions; texts of one id and copies in best partners and evidence."""

import math
from collections import Counter

from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import bags, contradict, retrieval, similarity

ODD = ["", None, "  ", "The cat, the CAT and a caterpillar", "é1x ÀB-c_d 007 7 000", "İstanbul straße ﬁne", "x" * 300 + " xxxxxx", "a b a\nb\tlong-winded", "9" * 20, "of the and"]


def test_bags_equal_tokens(spark):
    texts = spark.createDataFrame(list(enumerate(ODD * 3)), "id long, content string")
    want = {r.id: Counter(r.t or []) for r in texts.select("id", T.tokens(F.coalesce("content", F.lit(""))).alias("t")).collect()}
    got = {r.id: r for r in bags.bags(texts).collect()}
    for k, counts in want.items():
        by_number = dict(zip(bags.numbers(list(counts)).tolist(), counts.values()))
        assert dict(zip(got[k].k, got[k].tf)) == by_number and got[k].k == sorted(got[k].k) and got[k].dl == counts.total()
    assert all((got[a].hb == got[b].hb) == (want[a] == want[b]) and (got[a].h == got[b].h) == (want[a].keys() == want[b].keys()) for a in got for b in got)
    assert bags.numbers([]).tolist() == [] and len(set(bags.numbers(["", "0", "00", "a", "a0", "0a", "zzzzzzz"]).tolist())) == 7


def test_first_documents_of_a_table(spark):
    """Whole texts as queries, with documents as a table and as an index."""
    nodes = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 37}" for j in range(k % 9))) for k in range(80)], "id long, content string")
    queries = nodes.selectExpr("id + 500 AS qid", "concat(content, ' w1 w5 new') AS text")
    plain = {(r.qid, r.id): r.score for r in retrieval.ranked(retrieval.bm25(nodes, queries), 1).collect()}
    for index in (nodes, retrieval.build(nodes, queries)):
        found = {(r.qid, r.id): r.score for r in similarity.best_bm25(index, queries).collect()}
        assert found.keys() == plain.keys() and all(abs(found[k] - plain[k]) < 2e-6 for k in plain)


def test_best_partners_where_ids_repeat(spark):
    """One row for an id, whose texts are one bag, or sets of one id that are no partners of each other."""
    rows = [(1, "red blue"), (1, "green teal"), (2, "red blue green"), (3, "teal"), (4, "alone"), (4, "alone"), (5, None)]
    nodes = spark.createDataFrame(rows, "id long, content string")
    tf = {}
    for k, t in rows:
        tf.setdefault(k, Counter()).update((t or "").split())
    df = Counter(w for c in tf.values() for w in c)
    vec = {k: {w: n * (math.log((1 + len(rows)) / (1 + df[w])) + 1) for w, n in c.items()} for k, c in tf.items()}
    size = {k: math.sqrt(sum(x * x for x in v.values())) for k, v in vec.items()}
    want = {a: round(max(sum(x * vec[b].get(w, 0) for w, x in vec[a].items()) / size[a] / size[b] for b in vec if b != a and vec[a].keys() & vec[b].keys()), 6) for a in (1, 2, 3)}
    got = similarity.best_tfidf(nodes).collect()
    assert len(got) == 3 and all(abs(want[r.id] - r.top) < 2e-6 for r in got)
    best = similarity.best_jaccard(bags.bags(nodes)).collect()
    assert sorted((r.id, round(r.best, 6)) for r in best) == [(1, 0.666667), (2, 0.666667), (3, 0.5), (4, 0.0), (5, 0.0)]


def test_evidence_of_copies(spark):
    """Every pair of copies has its rows, with sentences compared once."""
    one, two = "the engine of the blue car starts on cold mornings.", "the engine of the red car starts on cold mornings."
    other = "nothing of this is like the lines before it at all."
    texts = {1: [one, other], 2: [two], 3: [one, other], 4: [two], 5: [one, two]}
    sentences = spark.createDataFrame(list(texts.items()), "id long, ss array<string>")
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts if a < b], "a long, b long")
    stems = {x: frozenset(bags_of) for x, bags_of in ((r.x, r.t) for r in spark.createDataFrame([(one,), (two,), (other,)], "x string").select("x", T.stems(F.col("x")).alias("t")).collect())}
    near = lambda x, y: len(stems[x] & stems[y]) / len(stems[x] | stems[y])
    want = Counter((a, b, x, y, round(near(x, y), 6)) for a in texts for b in texts if a < b for x in texts[a] for y in texts[b] if x != y and near(x, y) >= 0.5)
    got = contradict.evidence(pairs, sentences, 0.5).collect()
    assert Counter((r.older, r.newer, r.x, r.y, round(r.score, 6)) for r in got) == want and len(want) >= 8
    given = contradict.evidence(pairs, sentences, 0.5, lambda x, y: T.jaccard(T.stems(x), T.stems(y))).collect()
    assert Counter((r.older, r.newer, r.x, r.y, round(r.score, 6)) for r in given) == want
    plan = contradict.evidence(pairs, sentences, 0.5)._jdf.queryExecution().analyzed().toString()
    assert "Generate explode" not in plan  # all sentences of all pairs were unfolded before
