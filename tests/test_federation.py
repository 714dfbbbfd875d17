from pyspark.sql import functions as F

from quillgraph.operators.audit import audit
from quillgraph.operators.federation import COLUMNS, import_changeset

SCHEMA = "uuid string, content string, channel string, label {t}, conf_label {t}, status string, tombstoned int, redacted int, origin string"


def _import(spark, local, edges, sent, sent_edges, trusted, records=()):
    node = lambda uuid, channel="user", label=2, conf=0, status="live", dead=0, gone=0, origin=None: (uuid, f"text of {uuid}", channel, label, conf, status, dead, gone, origin)
    df = lambda rows, kind: spark.createDataFrame([node(**r) for r in rows], SCHEMA.format(t=kind))
    pairs = lambda rows: spark.createDataFrame(list(rows), "child string, parent string")
    out = import_changeset(df(local, "int"), pairs(edges), df(sent, "string"), pairs(sent_edges), "peer", trusted, spark.createDataFrame([(u,) for u in records], "uuid string"))
    return {r.uuid: r for r in out["nodes"].collect()}, {tuple(r) for r in out["edges"].collect()}, out["stats"].first()


def test_untrusted_origin_gets_the_floor_and_no_edges_of_known_nodes(spark):
    nodes, edges, stats = _import(spark, [{"uuid": "a"}], [], [{"uuid": "a"}, {"uuid": "b", "channel": "endorsed", "label": "3", "conf": "x"}, {"uuid": "c", "channel": "agent-derived", "label": "3", "conf": "9"}, {"uuid": ""}], [("a", "b"), ("c", "b"), ("c", "zz")], False)
    assert set(nodes) == {"a", "b", "c"} and (nodes["b"].channel, nodes["b"].label, nodes["b"].conf_label) == ("external", 0, 1) and nodes["c"].conf_label == 3
    assert edges == {("c", "b")} and (stats.nodes_new, stats.edges_new) == (2, 1) and nodes["a"].content == "text of a"


def test_only_the_owner_ends_a_node_and_nothing_comes_back(spark):
    local = [{"uuid": "own", "origin": "peer"}, {"uuid": "other", "origin": "home"}, {"uuid": "none"}, {"uuid": "dead", "dead": 1, "gone": 1, "status": "quarantined", "origin": "peer"}, {"uuid": "child", "channel": "agent-derived", "label": 2}, {"uuid": "rec", "origin": "home"}]
    sent = [{"uuid": u, "dead": 1, "gone": 1, "status": "quarantined"} for u in ("own", "other", "none")] + [{"uuid": "dead"}, {"uuid": "rec"}]
    nodes, _, stats = _import(spark, local, [("child", "own"), ("child", "rec")], sent, [], True, ["rec"])
    assert (nodes["own"].tombstoned, nodes["own"].redacted, nodes["own"].status, nodes["own"].content) == (1, 1, "quarantined", "")
    assert all((nodes[u].tombstoned, nodes[u].redacted, nodes[u].status) == (0, 0, "live") for u in ("other", "none"))
    assert (nodes["dead"].tombstoned, nodes["dead"].redacted, nodes["dead"].status) == (1, 1, "quarantined") and stats.resurrections_blocked == 3
    assert nodes["child"].tombstoned == 1 and nodes["child"].redacted == 1 and nodes["child"].content == "" and nodes["rec"].redacted == 1 and nodes["rec"].tombstoned == 0
    assert (stats.nodes_new, stats.nodes_updated) == (0, 2)


def test_labels_follow_the_edges_that_were_taken(spark):
    local = [{"uuid": "d", "channel": "agent-derived", "label": 2, "origin": "peer"}, {"uuid": "u", "label": 2}]
    nodes, edges, stats = _import(spark, local, [("d", "u")], [{"uuid": "e", "channel": "external", "conf": "2"}, {"uuid": "e", "channel": "external", "conf": "2"}, {"uuid": "n", "channel": "agent-derived", "label": "7"}], [("d", "e"), ("u", "e"), ("n", "e"), ("d", "u")], True)
    assert edges == {("d", "u"), ("d", "e"), ("n", "e")} and nodes["d"].label == 0 and nodes["d"].conf_label == 2 and nodes["n"].label == 0
    again = _import(spark, [{"uuid": "x", "channel": "user"}], [], [], [], True)
    assert again[2].nodes_new == 0 and again[2].edges_new == 0 and set(again[0]) == {"x"} and set(COLUMNS) <= set(again[0]["x"].asDict())


def test_audit_of_a_folder(spark):
    schema = "file string, stem string, name string, description string, type string, section string, in_index string, reason string, content string"
    ok = ("n", "d", "user", None, None, None)
    rows = [("a.md", "a", *ok, "[[B]] [[b_x]] [[nowhere]] [[nowhere]]"), ("b.md", "b", "n", None, "odd", None, None, None, None), ("b-x.md", "b-x", "n", "d", "user", "NONE", None, None, "[[Nowhere]]"),
            ("c.md", "c", *ok, ""), ("d.md", "d", *ok, ""), ("e.md", "e", "n", "d", "user", None, None, "lines", ""), ("f.md", "f", "n", "d", "user", None, None, "needs_cluster", "")]
    files = spark.createDataFrame(rows, schema)
    index = spark.createDataFrame([("a.md",), ("gone.md",)], "file string")
    store = spark.createDataFrame([("a", "hot"), ("b", "hot"), ("d", "cold")], "stem string, tier string")
    got = sorted((r.name, r.severity, r.target, r.detail) for r in audit(files, index, store, 10, 20).collect())
    assert got == sorted([("orphan-file", "ERROR", "b.md", None), ("withdrawn", "INFO", "b-x.md", None), ("pending-import", "INFO", "c.md", None), ("needs-cluster", "INFO", "f.md", None), ("dead-index-link", "ERROR", "gone.md", None),
                          ("frontmatter-missing", "ERROR", "b.md", "description"), ("bad-type", "WARN", "b.md", "odd"), ("broken-wikilink", "INFO", "nowhere", "1"), ("broken-wikilink", "INFO", "Nowhere", "1")])
    blind = {(r.name, r.severity) for r in audit(files, index, None).where(F.col("target") == "d.md").collect()}
    assert blind == {("orphan-file", "WARN")} and audit(files.limit(0), index.limit(0), store.limit(0)).count() == 0
