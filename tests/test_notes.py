"""Links and front matter, by hand and against a reading of one character at a time."""

import random

import pytest

from quillgraph.operators import notes


@pytest.mark.parametrize(("text", "want"), [
    ("[[a|x]] ![[b#h|y z]] [t](u) ![i](j.png)", ["a", "b", "u", "j.png"]),
    ("````\n[[a]]\n```\n[[b]]\n`````\n[[c]]", ["c"]),  # a shorter run does not close
    ("~~~\n[[a]]\n```\n[[b]]\n~~~\n[[c]]\n```\n[[d]]", ["c"]),  # another kind does not close, an open fence hides the rest
    ("  ```py\n[[a]]\n  ```\n[[b.md]]", ["b"]),
    ("``a ` [[x]] `` [[b]] `[[c]]` [[d]]", ["b", "d"]),
    ("``never closed `[[a]]` [[b]]", ["a", "b"]),
    ("`one ``[[a]]`` two` [[b]]", ["b"]),
    ("<!-- [[a]]\n[[b]] --> [[c]] \\[[d]] [[e\\]]", ["c"]),
    ("    [[a]]\n\t[[b]]\n   [[c]]", ["c"]),
    ("---\nx: [[no]]\n---\n[[yes]]", ["yes"]),
    ("[t](a%20b.md \"title\") [u](https://x#y) [v](#here) [[#here]] [w](n.md#h) [x]( )", ["a b.md", "https://x#y", "n.md"]),
    ("", []),
])
def test_links(text, want):
    assert [x[1] for x in notes.links_of(notes.split_note(text)[1])] == want


def _spans(line):
    """One character at a time."""
    out, i = "", 0
    while i < len(line):
        if line[i] != "`":
            out += line[i]
            i += 1
            continue
        n = len(line[i:]) - len(line[i:].lstrip("`"))
        j, shut = i + n, None
        while j < len(line):
            if line[j] != "`":
                j += 1
                continue
            m = len(line[j:]) - len(line[j:].lstrip("`"))
            if m == n:
                shut = j + m
                break
            j += m
        if shut is None:
            return out + line[i:]
        out += " "
        i = shut
    return out


def test_spans_of_any_runs():
    rnd = random.Random(1)
    for _ in range(4000):
        line = "".join(rnd.choice(["`", "``", "```", "a", "[[b]]", " "]) for _ in range(rnd.randint(0, 12)))
        assert notes.outside_spans(line) == _spans(line), line


def test_front_matter():
    text = "---\na: 1\n# no: pair\nb: 'x y'\nlist:\n  - one\n- \"two\"\ninline: [p, 'q r', , s]\nnone: []\nscalar: v\n- lost\nempty:\na: 2\n...\nbody\n---\n"
    fields, body = notes.split_note(text)
    assert [tuple(x[:2]) + (tuple(x[2]) if x[2] is not None else None,) for x in fields] == [("a", "2", None), ("b", "x y", None), ("list", None, ("one", "two")), ("inline", None, ("p", "q r", "s")), ("none", None, ()), ("scalar", "v", None), ("empty", "", None)]
    assert body == "body\n---"
    assert notes.split_note("---\na: 1\nno end") == ([], "---\na: 1\nno end") and notes.split_note("x\n---\na: 1\n---") == ([], "x\n---\na: 1\n---")


def test_tables(spark):
    rows = [(1, "---\nt: [a]\n---\n[[b|c]] [[b]]", "x"), (1, "[[b|c]]", "x"), (2, None, None), (3, "", "y"), (None, "[[z]] " * 20_000, "y")]
    df = spark.createDataFrame(rows, "id long, content string, target string")
    got = notes.links(df).groupBy("id", "target", "alias").count().collect()
    assert sorted(map(str, ((r.id, r.target, r.alias, r["count"]) for r in got))) == sorted(map(str, [(1, "b", "c", 2), (1, "b", None, 1), (None, "z", None, 20_000)]))
    assert [tuple(r) for r in notes.fields(df).collect()] == [(1, 0, "t", None, ["a"])]
    assert notes.links(df.limit(0)).count() == notes.fields(df.limit(0)).count() == 0
