"""Prefix scans, and digests against the loop that sheds one entry at a time."""

import random

import pytest

from quillgraph.operators import digest, scan


@pytest.mark.parametrize("ranges", [1, 3, 17])
def test_running_sums(spark, ranges):
    rnd = random.Random(ranges)
    rows = [(rnd.choice([0, 0, 0, 0, 1, 2, None]), rnd.choice([None, 1, 2, 3]), n, rnd.choice([None, 1, 5, -2]), n) for n in range(300)]
    df = spark.createDataFrame(rows, "k int, o int, range int, v long, b_sum long")
    got = {r.range: r.v_sum for r in scan.running_sums(df, ["k"], ["o", "range"], ["v"], ranges).collect()}
    want, total = {}, {}
    for k, o, n, v, _ in sorted(rows, key=lambda r: (r[1] if r[1] is not None else 0, r[2])):
        total[k] = want[n] = total.get(k, 0) + (v or 0)
    assert got == want
    assert scan.running_sums(df.limit(0), [], ["o"], ["v"]).count() == 0
    plan = scan.running_sums(df, ["k"], ["o", "range"], ["v"], ranges)._jdf.queryExecution().optimizedPlan().toString()
    assert all("range_#" in line for line in plan.splitlines() if "windowspecdefinition" in line)


def _text(title, live):
    lines = [title, ""]
    for s in sorted({e["section"] for e in live}):
        own = [e for e in live if e["section"] == s]
        lines += [f"## {s}", *(e["line"] for e in own if e["kind"] == "literal"), *(e["line"] for e in sorted((e for e in own if e["kind"] == "file"), key=lambda e: e["id"])), ""]
    return "\n".join(lines).rstrip() + "\n"


def _loop(entries, budget, max_lines, title, cap):
    out = {e["id"]: "unsectioned" for e in entries if e["section"] is None}
    live = [e for e in entries if e["section"] is not None]
    if cap:
        for s in {e["section"] for e in live}:
            size = lambda s=s: len(("\n".join([f"## {s}", *(e["line"] for e in live if e["section"] == s), ""]) + "\n").encode())
            free = sorted((e for e in live if e["section"] == s and e["kind"] == "file" and not e["cluster"]), key=lambda e: (bool(e["own_line"]), -(e["born"] if e["born"] is not None else -1), e["rs"] or 0.0, e["id"]))
            while free and size() > cap:
                gone = free.pop(0)
                live.remove(gone)
                out[gone["id"]] = "section_budget"
    free = sorted((e for e in live if e["kind"] == "file" and not e["pinned"]), key=lambda e: (bool(e["live_state"]), e["rs"] or 0.0, e["id"]))
    while True:
        text = _text(title, live)
        over = len(text.encode()) > budget
        if not over and text.count("\n") <= max_lines:
            return out | {e["id"]: None for e in live}, text
        if not free:
            raise digest.DigestTooLarge
        gone = free.pop(0)
        live.remove(gone)
        out[gone["id"]] = "budget" if over else "lines"


@pytest.mark.parametrize(("seed", "budget", "max_lines", "cap"), [(1, 900, 1000, None), (2, 100_000, 25, None), (3, 1200, 40, 260), (4, 700, 22, 200), (5, 100_000, 1000, None), (6, 60, 9, 150)])
def test_digest_sheds_as_the_loop_does(spark, seed, budget, max_lines, cap):
    rnd = random.Random(seed)
    one = lambda *x: rnd.choice(x)
    entries = [{"id": n, "section": one("A", "Bü", "C", "D", None), "kind": one("file", "file", "file", "literal") if seed < 6 else "file", "cluster": one(True, False, None), "own_line": one(True, False, None), "pinned": seed < 6 and n % 13 == 0, "live_state": one(True, False, False), "rs": one(None, 0.5, 1.0, 2.0), "born": one(None, 1, 2, 3), "line": f"- [note {n}](n{n}.md) — " + "ä" * rnd.randint(0, 30)} for n in range(70)]
    for e in entries[20:]:
        e["kind"] = "file" if e["kind"] == "literal" and rnd.random() < 0.8 else e["kind"]
    df = spark.createDataFrame([tuple(e[c] for c in digest.ENTRY) + ("clash",) for e in entries], "id int, section string, kind string, cluster boolean, own_line boolean, pinned boolean, live_state boolean, rs double, born int, line string, fits string")
    try:
        want, text = _loop(entries, budget, max_lines, "# Memory", cap)
    except digest.DigestTooLarge:
        with pytest.raises(digest.DigestTooLarge):
            digest.digest(df, budget, max_lines, caps=cap)
        return
    kept = digest.digest(df, budget, max_lines, caps=cap)
    assert {r.id: r.reason for r in kept.collect()} == want
    assert all(r.kept == (r.reason is None) for r in kept.collect())
    if any(v is None for v in want.values()):
        assert digest.render(df, kept).first().text == text


def test_a_digest_of_nothing(spark):
    df = spark.createDataFrame([], "id int, section string, kind string, cluster boolean, own_line boolean, pinned boolean, live_state boolean, rs double, born int, line string")
    assert digest.digest(df, 100, 10, caps=50).count() == 0


def test_what_never_goes_may_fill_the_digest(spark):
    rows = [(n, "A", "literal" if n < 5 else "file", False, False, n == 9, False, 1.0, n, "x" * 30) for n in range(12)]
    df = spark.createDataFrame(rows, "id int, section string, kind string, cluster boolean, own_line boolean, pinned boolean, live_state boolean, rs double, born int, line string")
    for budget, lines, why in ((100, 1000, "budget"), (100_000, 6, "lines")):
        with pytest.raises(digest.DigestTooLarge):
            digest.digest(df, budget, lines)
        got = {r.id: (r.kept, r.reason) for r in digest.digest(df, budget, lines, strict=False).collect()}
        assert got == {n: (True, None) if n < 5 or n == 9 else (False, why) for n in range(12)}
