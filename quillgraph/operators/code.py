"""Code index: chunks of source files, and retrieval over them.

Python files are cut into their functions and classes, nested ones too; files that do not parse, and all others, into windows of
lines. Cutting is a table function over Arrow batches, so each file is one row in and its chunks come out one by one.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import retrieval

#: Fixed value: lines of a window.
WINDOW_LINES = 60
CHUNK = "file_id long, repo string, path string, symbol string, kind string, start_line int, end_line int, content string"


def windows(text: str) -> list[tuple[str, str, int, int, str]]:
    """(symbol, kind, first line, last line, content) of each window that is not blank."""
    lines, out = text.splitlines(), []
    for at in range(0, len(lines), WINDOW_LINES):
        part = lines[at : at + WINDOW_LINES]
        if any(x.strip() for x in part):
            out.append((f"L{at + 1}-{at + len(part)}", "window", at + 1, at + len(part), "\n".join(part)))
    return out


def symbols(text: str) -> list[tuple[str, str, int, int, str]] | None:
    """Functions and classes of a Python text, by position; None if it does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    found = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) and (source := ast.get_source_segment(text, node)):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            found.setdefault((node.lineno, node.name), (node.name, kind, node.lineno, node.end_lineno, source))
    return [found[k] for k in sorted(found)]


def chunks_of(path: str, text: str | None) -> list[tuple[str, str, int, int, str]]:
    if not text or not text.strip():
        return []
    found = symbols(text) if path.endswith((".py", ".pyi")) else None
    return found or windows(text)  # a file without any symbol is still found


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
    names = [c.split()[0] for c in CHUNK.split(", ")]
    for batch in batches:
        for file_id, repo, path, text in zip(*(batch.column(c).to_pylist() for c in ("file_id", "repo", "path", "text")), strict=True):
            rows = [(file_id, repo, path, *chunk) for chunk in chunks_of(path or "", text)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def chunk_files(files: DataFrame) -> DataFrame:
    """CHUNK rows of files(file_id, repo, path, text)."""
    return files.select(F.col("file_id").cast("long").alias("file_id"), "repo", "path", "text").mapInArrow(_cut, CHUNK)


def indexable(files: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of files(repo, path, text) those that known(repo, path, hash) has not in this form, and the (repo, path) to prune: gone or
    changed."""
    now = files.withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    new = now.join(known.select("repo", "path", "hash"), ["repo", "path", "hash"], "left_anti")
    prune = known.join(now.select("repo", "path", "hash"), ["repo", "path", "hash"], "left_anti").select("repo", "path")
    return new, prune


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """(repo, path, chunks, lines)."""
    return chunks.groupBy("repo", "path").agg(F.count("*").alias("chunks"), F.sum(F.col("end_line") - F.col("start_line") + 1).cast("long").alias("lines"))


def code_retrieve(index: DataFrame | retrieval.Built, queries: DataFrame, k: int, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, prefilter: int = 400) -> DataFrame:
    """(qid, id, score, rank) over chunks index(id, content), or what a text index of them gives: BM25, and with vectors the fusion with the cosine of the ``prefilter``
    best BM25 candidates of any query, so the dense stage does not grow with the index."""
    lexical = retrieval.ranked(retrieval.bm25(index, queries), prefilter)
    if vectors is None:
        return lexical.where(F.col("rank") <= k)
    near = retrieval.dense(vectors.join(lexical.select("id").distinct(), "id", "left_semi"), query_vectors)
    near = near.join(lexical.select("qid", "id"), ["qid", "id"], "left_semi")
    return retrieval.ranked(retrieval.rrf(lexical, retrieval.ranked(near)), k)
