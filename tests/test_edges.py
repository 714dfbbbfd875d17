"""The edges as Spark reads them: the rows of their SQL, by joins of keys; loops derive them once."""

from quillgraph.operators import federation, graph
from quillgraph.plans import queries_support
from quillgraph.plans.views import VIEWS, Store


def test_edges_are_joined_by_keys(spark, sf):
    s = Store(spark, sf)
    assert "CartesianProduct" not in s.edges._jdf.queryExecution().executedPlan().toString()
    want, got = s.sql(VIEWS["edges"]), s.edges
    assert want.count() == got.count() > 0 and want.exceptAll(got).isEmpty()


def test_stats_of_an_import_need_no_loops(spark, sf, monkeypatch):
    s = Store(spark, sf)
    want = queries_support._imported(s, True)["stats"].collect()
    monkeypatch.setattr(graph, "reachable", None)
    monkeypatch.setattr(graph, "lattice", None)
    assert queries_support._imported(s, True, federation.import_stats).collect() == want
