import json

import pytest

from quillgraph.sources import files, jsonl


def _tree(root, names, content="x"):
    for n in names:
        p = root / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content if isinstance(content, bytes) else content.encode())


def test_files_are_read_with_replacement_and_by_glob(spark, tmp_path):
    _tree(tmp_path, ["a.txt", "s/b.txt", "s/t/c.md"])
    (tmp_path / "s/bad.txt").write_bytes(b"ok \xff\xfe end")
    got = {r.rel: r.text for r in files.text_files(spark, str(tmp_path), "*.txt").collect()}
    assert set(got) == {"a.txt", "s/b.txt", "s/bad.txt"} and got["a.txt"] == "x" and got["s/bad.txt"].startswith("ok \ufffd")


def test_note_memory_and_code_trees(spark, tmp_path):
    _tree(tmp_path / "n", ["a.md", "B.MD", "x/c.md", ".trash/d.md", "x/.obsidian/e.md", ".f.tmp", "g.md~", ".#h.md", "i.txt", "x/git2/j.md"])
    assert {r.rel for r in files.notes(spark, f"file://{tmp_path}/n").collect()} == {"a.md", "B.MD", "x/c.md", "x/git2/j.md"}
    _tree(tmp_path / "m", ["one.md", "MEMORY.md", "projects/p.md", "projects/INDEX.md", "projects/q/r.md", "projects/q/s/t.md", "other/u.md"])
    assert {r.rel for r in files.memories(spark, f"{tmp_path}/m").collect()} == {"one.md", "projects/p.md", "projects/q/r.md"}
    _tree(tmp_path / "c", ["a.py", "b.PY", "d.txt", "node_modules/e.js", "src/build/f.c", "src/g.rs"])
    _tree(tmp_path / "c", ["big.py"], "x" * (files.MAX_CODE_BYTES + 1))
    assert {r.rel for r in files.code_files(spark, f"{tmp_path}/c").collect()} == {"a.py", "b.PY", "src/g.rs"}


def test_lines_are_numbered_across_splits(spark, tmp_path):
    text = "".join(f"line {k}\n" if k % 7 else "\n" for k in range(1, 2001))
    (tmp_path / "big.jsonl").write_text(text)
    (tmp_path / "two.jsonl").write_text("first\r\nsecond")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = [(r.name, r.n, r.line) for r in files.lines(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(got) == sorted([("big.jsonl", k, f"line {k}") for k in range(1, 2001) if k % 7] + [("two.jsonl", 1, "first"), ("two.jsonl", 2, "second")])


def _write(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def test_transcripts_of_the_message_form(spark, tmp_path):
    _write(tmp_path / "a.jsonl", [
        {"type": "user", "message": {"role": "user", "content": "[hello]"}}, "{broken", "", '"a string"', "[1]",
        {"type": "assistant", "message": {"content": [{"type": "text", "text": "one"}, {"type": "tool_use", "name": "x"}, "two", {"text": 5}]}},
        {"type": "queue-operation", "message": {"content": "no"}}, {"type": "user", "message": "no object"}, {"type": "user", "message": {"content": "  "}}, {"type": "user"}])
    got = sorted(tuple(r) for r in jsonl.transcripts(spark, str(tmp_path), "message").collect())
    assert got == [("a.jsonl#L1", "user", "user", "[hello]"), ("a.jsonl#L6", "assistant", "agent-derived", "one\ntwo")]


def test_transcripts_of_the_payload_form(spark, tmp_path):
    message = lambda role, content, kind="response_item", inner="message": {"type": kind, "payload": {"type": inner, "role": role, "content": content}}
    _write(tmp_path / "r.jsonl", [message("user", [{"type": "input_text", "text": "q"}]), {"type": "event_msg", "payload": {"type": "user_message", "message": "q"}}, message("developer", "rules"), message("assistant", "a"), message("assistant", "f", inner="function_call"), {"type": "session_meta"}])
    got = sorted(tuple(r) for r in jsonl.transcripts(spark, str(tmp_path), "payload").collect())
    assert got == [("r.jsonl#L1", "user", "user", "q"), ("r.jsonl#L4", "assistant", "agent-derived", "a")]
    with pytest.raises(ValueError):
        jsonl.transcripts(spark, str(tmp_path), "other")


def test_usage_events_after_a_cutoff(spark, tmp_path):
    _write(tmp_path / "u.jsonl", [{"ts": "2024-01-01T00:00:00Z", "stem": "a", "hits": 1}, {"ts": "2024-01-02T00:00:00Z", "stem": "a", "hits": 2}, {"ts": "2024-01-03T01:00:00+01:00", "stem": "b", "hits": 1}, {"ts": "never", "stem": "c", "hits": 3}, {"ts": "2024-01-05T00:00:00Z", "stem": "d", "hits": 0}, "oops"])
    got = {r.stem: (r.n, r.hits) for r in jsonl.usage_by_stem(jsonl.usage_events(spark, str(tmp_path), "2024-01-01T00:00:00Z")).collect()}
    assert got == {"a": (1, 2), "b": (1, 1), "c": (1, 3)}


def test_changesets_round_trip_skip_damage_and_need_a_header(spark, tmp_path):
    nodes = spark.createDataFrame([("s:1", "é", 2), ("s:2", None, 0)], "uuid string, content string, label int")
    edges = spark.createDataFrame([("s:2", "s:1")], "child string, parent string")
    gone = spark.createDataFrame([("s:9", None)], "uuid string, redacted_at string")
    shared = tmp_path / "sync"
    path = jsonl.sync_out(str(shared), "s", "2024-01-01T00:00:00+00:00", nodes, edges, gone)
    (shared / "origin=s" / "zz.txt").write_text('{"type": "edge", "child": "s:3"}\n{"type": "node", "uuid\n{"type": "redaction"}\n7\n')
    read = jsonl.read_changeset(spark, path, "uuid string, content string, label int")
    assert sorted(map(tuple, read["nodes"].collect())) == [("s:1", "é", 2), ("s:2", None, 0)]
    assert list(map(tuple, read["edges"].collect())) == [("s:2", "s:1")] and read["redactions"].first().uuid == "s:9" and read["header"].first().origin == "s"
    (shared / "origin=t").mkdir()
    (shared / "origin=t" / "x.txt").write_text('{"type": "node", "uuid": "t:1"}\n')
    with pytest.raises(ValueError):
        jsonl.read_changeset(spark, str(shared / "origin=t"), "uuid string")
    both = jsonl.sync_in(spark, str(shared), "u", "uuid string, content string, label int")
    assert {(r.uuid, r.origin) for r in both["nodes"].collect()} == {("s:1", "s"), ("s:2", "s")}
    assert jsonl.sync_in(spark, str(shared), "s", "uuid string") == {}
