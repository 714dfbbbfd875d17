"""Links and front matter of notes, as tables.

A note is read line by line in Arrow batches: fences, comments and backtick runs have state that no single pattern holds. Links come
from what is left of the prose, in order.

Defined results: a null or empty note has no links and no front matter; front matter needs its first line and an end; a note of any
length is one value in memory; repeated rows and equal or null ids give rows of their own; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import bounded_batches

LINK = "id long, pos int, kind string, target string, heading string, alias string, embed boolean"
FIELD = "id long, pos int, key string, value string, items array<string>"

_COMMENT = re.compile(r"<!--.*?-->", re.S)
_FENCE = re.compile(r"\s*(`{3,}|~{3,})")
_RUN = re.compile("`+")
_LINKS = re.compile(r"(!?)(?:\[\[([^\[\]]+)\]\]|\[[^\]]*\]\(([^)]+)\))")
_ITEM, _PAIR = re.compile(r"\s*-\s+(.*)$"), re.compile(r"([A-Za-z0-9_-]+)\s*:\s*(.*)$")


def outside_spans(line: str) -> str:
    """The line without its code spans: text between two runs of as many backticks. Behind a run that never closes all stays."""
    out, at, runs = [], 0, list(_RUN.finditer(line))
    while runs:
        opened, *runs = runs
        closed = next((k for k, r in enumerate(runs) if len(r[0]) == len(opened[0])), None)
        if closed is None:
            break
        out.append(line[at : opened.start()])
        at = runs[closed].end()
        runs = runs[closed + 1 :]
    return " ".join([*out, line[at:]])


def prose(text: str) -> Iterator[str]:
    """Lines outside fences, indented code and comments, without code spans and escaped brackets."""
    fence = ""
    for line in _COMMENT.sub(" ", text).replace("\\[", "  ").replace("\\]", "  ").splitlines():
        mark = _FENCE.match(line)
        if fence:
            # only a run of the same kind that is as long closes
            if mark and mark[1].startswith(fence):
                fence = ""
        elif mark:
            fence = mark[1]
        elif not line.startswith(("    ", "\t")):
            yield outside_spans(line)


def links_of(text: str) -> list[tuple]:
    """(kind, target, heading, alias, embed) of the links of a note's body: wiki links, paths of other notes, and addresses. Links
    to a place in the note itself have no target and are left out."""
    found = []
    for line in prose(text):
        for bang, inner, url in _LINKS.findall(line):
            if inner:
                place, _, alias = inner.partition("|")
                target, _, heading = place.partition("#")
                target = re.sub(r"\.md$", "", target.strip())
                found.append(("wiki", target, heading.strip() or None, alias.strip() or None, bool(bang)))
            elif url.strip():
                # a title may follow the address; blanks inside are written %20
                place = unquote(url.split()[0])
                outside = "://" in place or place.startswith("mailto:")
                target, _, heading = (place, "", "") if outside else place.partition("#")
                found.append(("url" if outside else "path", target, heading or None, None, bool(bang)))
    return [x for x in found if x[1]]


def _bare(value: str) -> str:
    value = value.strip()
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value


def split_note(text: str) -> tuple[list[list], str]:
    """([[key, value, items]], body): scalars have a value, lists their items; a later key of the same name takes the place of an earlier."""
    lines = text.splitlines()
    end = next((k for k, x in enumerate(lines[1:], 1) if x.strip() in ("---", "...")), None) if lines and lines[0].strip() == "---" else None
    if end is None:
        return [], text
    fields: dict[str, list] = {}
    last = None
    for line in lines[1:end]:
        item, pair = _ITEM.match(line), _PAIR.match(line)
        if item and last is not None:
            # an empty value becomes a list; items behind a scalar belong to nothing
            if last[1] == "":
                last[1], last[2] = None, []
            if last[2] is not None:
                last[2].append(_bare(item[1]))
        elif pair:
            value = pair[2].strip()
            last = [pair[1], _bare(value), None]
            if value[:1] == "[" and value[-1:] == "]":
                last[1:] = [None, [_bare(x) for x in value[1:-1].split(",") if x.strip()]]
            fields[pair[1]] = last
    return list(fields.values()), "\n".join(lines[end + 1 :])


def _table(make, schema: str):
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, *x) for i, text in zip(batch.column("id").to_pylist(), batch.column("content").to_pylist(), strict=True) for n, x in enumerate(make(text or ""))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def _rows(notes: DataFrame) -> DataFrame:
    bounded_batches(notes.sparkSession)
    return notes.select(F.col("id").cast("long").alias("id"), F.col("content").cast("string").alias("content"))


def links(notes: DataFrame) -> DataFrame:
    """LINK rows of notes(id, content); front matter holds none."""
    return _rows(notes).mapInArrow(_table(lambda text: links_of(split_note(text)[1]), LINK), LINK)


def fields(notes: DataFrame) -> DataFrame:
    """FIELD rows of notes(id, content): the front matter, a scalar's value or a list's items."""
    return _rows(notes).mapInArrow(_table(lambda text: split_note(text)[0], FIELD), FIELD)
