"""The text index that stays, against one made anew."""

import math
import re

import pytest

from quillgraph.operators import retrieval, textindex
from quillgraph.shared import shared_path

ODD = [(1, "alpha beta"), (1, "alpha gamma"), (2, "beta"), (3, None), (4, ""), (None, "alpha of nobody"), (5, "The K of İstanbul, alpha!"), (6, "alpha " * 20_000), (7, "alpha beta"), (7, "alpha beta")]


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "id long, content string, term string")


def _queries(spark):
    return spark.createDataFrame([(0, "alpha gamma"), (1, "beta beta of unknown"), (2, "istanbul k stanbul"), (3, ""), (4, None)], "qid long, text string")


def _scores(built, queries):
    return sorted((q, str(i), s) for q, i, s in retrieval.bm25(built, queries).collect())


def _same(spark, index, rows):
    queries = _queries(spark)
    plain = retrieval.build(_docs(spark, rows), queries)
    assert _scores(index.lookup(queries), queries) == _scores(plain, queries)
    assert [(r.n, r.avgdl and round(r.avgdl, 6)) for r in index.lookup(queries).stats.collect()] == [(r.n, r.avgdl and round(r.avgdl, 6)) for r in plain.stats.collect()]


@pytest.mark.parametrize("terms", [0, 2, 100_000])
def test_rows_are_documents_whatever_the_number_of_terms(spark, monkeypatch, terms):
    """Equal ids were one document beyond TERMS, and several below."""
    queries = _queries(spark)
    want = _scores(retrieval.build(_docs(spark, ODD), queries), queries)
    monkeypatch.setattr(retrieval, "TERMS", terms)
    assert _scores(retrieval.build(_docs(spark, ODD), queries), queries) == want
    three, one = _docs(spark, [(1, "alpha beta"), (1, "alpha gamma"), (2, "beta")]), spark.createDataFrame([(0, "alpha gamma")], "qid long, text string")
    part = lambda df: math.log((3 - df + 0.5) / (df + 0.5) + 1) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / (5 / 3)))
    assert [(r.id, r.score) for r in retrieval.bm25(three, one).collect()] == [(1, round(2 * part(2) + part(1), 6))]


def test_an_index_that_is_changed_equals_one_made_anew(spark):
    index = textindex.TextIndex.create(spark, _docs(spark, ODD), buckets=5)
    _same(spark, index, ODD)
    later = [(1, "alpha beta"), (1, "alpha delta"), (2, "beta"), (3, "now beta"), (None, "gamma of nobody"), (6, "alpha"), (7, "alpha beta"), (8, "gamma"), (8, None)]
    assert index.refresh(_docs(spark, later)) == {"new": 1, "changed": 5, "gone": 2}
    _same(spark, index, later)
    assert index.refresh(_docs(spark, later)) == {}
    index.drop(_docs(spark, [(1, ""), (99, "")]))
    rest = [r for r in later if r[0] != 1]
    _same(spark, index, rest)
    index.add(_docs(spark, [(1, "gamma again")]))
    _same(spark, index, [*rest, (1, "gamma again")])
    index.drop(_docs(spark, [(None, "")]))
    rest = [*(r for r in rest if r[0] is not None), (1, "gamma again")]
    index.compact()
    _same(spark, index, rest)
    # another session opens the folder and sees the same
    again = textindex.TextIndex(spark, index.folder)
    assert again.manifest == index.manifest and again.manifest["drops"] == []
    _same(spark, again, rest)


def test_an_empty_index(spark):
    index = textindex.TextIndex.create(spark, _docs(spark, []))
    _same(spark, index, [])
    assert index.refresh(_docs(spark, [(1, "alpha")])) == {"new": 1}
    _same(spark, index, [(1, "alpha")])
    assert textindex.TextIndex(spark, shared_path(spark, "nothing")).manifest is None


def test_a_query_reads_the_buckets_of_its_terms(spark):
    index = textindex.TextIndex.create(spark, _docs(spark, [(k, f"word{k} alpha") for k in range(200)]), buckets=50)
    found = index.lookup(spark.createDataFrame([(0, "word7")], "qid long, text string")).postings
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 1
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (= \d+|IN \(\d+\))", plan) and "EqualTo(term,word7)" in plan


def test_a_writer_that_dies_changes_nothing(spark, monkeypatch):
    index = textindex.TextIndex.create(spark, _docs(spark, ODD))
    broken = textindex.TextIndex(spark, index.folder)
    monkeypatch.setattr(broken, "_publish", lambda **_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        broken.add(_docs(spark, [(9, "alpha")]))
    _same(spark, textindex.TextIndex(spark, index.folder), ODD)


def test_the_sessions_index_follows_its_files(spark):
    folder = shared_path(spark, "kept")
    write = lambda rows: _docs(spark, rows).write.mode("overwrite").parquet(folder)
    docs = lambda: spark.read.parquet(folder)
    write(ODD)
    first = textindex.kept(spark, "test", [folder], docs)
    assert textindex.kept(spark, "test", [folder], docs) is first
    write(ODD[:3])
    second = textindex.kept(spark, "test", [folder], docs)
    assert second is first
    _same(spark, second, ODD[:3])
