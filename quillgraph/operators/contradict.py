"""Contradiction sweep and citation firewall: the evidence is computed here, the verdict is the caller's.

The sweep pairs similar nodes, anchors sentences of one to sentences of the other, and keeps those pairs whose claim-bearing words
differ. An adjudicator is a function of two columns (premise, hypothesis) that gives the probability of a contradiction: a column
expression, or a pandas UDF around a model. Nodes up to a cursor were swept before; only pairs with a newer one are looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import bounded_batches, materialise
from .tiles import key


#: Sentences of a text that are compared with as many of another at once.
AT_ONCE = 512
_CLOSE = "ra long, rb long, at_a int, at_b int, score double"


def _close(anchor: float):
    """mapInArrow over (ra, rb, ka, kb), the numbered stems of each sentence of two texts: places of the sentences whose Jaccard similarity
    reaches the anchor, which is above 0. Products of ones are exact in single precision."""

    def ones(lists) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        out = []
        for at in range(0, len(lists), AT_ONCE):
            part = lists[at : at + AT_ONCE]
            n = np.array([len(x) for x in part])
            out.append((np.concatenate([np.zeros(0, np.int64), *part]).astype(np.int64), np.repeat(np.arange(len(part)), n), n))
        return out

    def dense(keys, own, row, n):
        out = np.zeros((len(n), len(keys)), np.float32)
        at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
        good = np.flatnonzero(keys[at] == own) if len(keys) else np.zeros(0, np.int64)
        out[row[good], at[good]] = 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in range(batch.num_rows):
                a, b = (ones(_lists(batch.column(c)[r].values)) for c in ("ka", "kb"))
                for m, (ka, row_a, na) in enumerate(a):
                    for k, (kb, row_b, nb) in enumerate(b):
                        keys = np.intersect1d(ka, kb)
                        n = (dense(keys, ka, row_a, na) @ dense(keys, kb, row_b, nb).T).astype(np.float64)
                        i, j = np.nonzero(n)
                        score = n[i, j] / (na[i] + nb[j] - n[i, j])
                        good = score >= anchor
                        if good.any():
                            found.append((np.full(good.sum(), r), i[good] + m * AT_ONCE, j[good] + k * AT_ONCE, score[good]))
            if found:
                r, i, j, score = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([batch.column("ra").take(pa.array(r)), batch.column("rb").take(pa.array(r)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(score)], ["ra", "rb", "at_a", "at_b", "score"])

    return run


def _lists(lists: pa.ListArray) -> list[np.ndarray]:
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    return [values[a:b] for a, b in zip(offsets, offsets[1:])]


def evidence(pairs: DataFrame, sentences: DataFrame, anchor: float, near: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(older, newer, x, y, score, differ) of pairs(a, b), a < b, and sentences(id, ss): sentence pairs whose nearness reaches the
    anchor. ``near`` replaces the overlap of stems, by a cosine of embeddings for example."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # texts of equal sentences are compared once, as the one with the least id
    known = materialise(sentences.join(ends, "id", "left_semi").select("id", "ss", F.sha2(F.to_json("ss"), 256).alias("h")), "sentences")
    reps = known.groupBy("h").agg(F.min("id").alias("rep"))
    members = materialise(known.select("id", "h").join(reps, "h").select("id", "rep"), "members")
    texts = known.join(members.where("id = rep").select("id"), "id", "left_semi").select("id", "ss")
    own = lambda end: members.select(F.col("id").alias(end), F.col("rep").alias(f"r{end}"))
    pairs = materialise(pairs.select("a", "b").join(own("a"), "a").join(own("b"), "b"), "pairs")
    both = pairs.select("ra", "rb").distinct()
    if near is None and anchor > 0:
        bounded_batches(pairs.sparkSession)
        stems = materialise(texts.select("id", F.transform("ss", lambda x: F.transform(T.stems(x), key)).alias("k")), "stems")
        own = lambda end: stems.select(F.col("id").alias(f"r{end}"), F.col("k").alias(f"k{end}"))
        places = both.join(own("a"), "ra").join(own("b"), "rb").select("ra", "rb", "ka", "kb").mapInArrow(_close(anchor), _CLOSE)
        lines = materialise(texts.select("id", F.posexplode("ss").alias("at", "s")), "lines")
        own = lambda end, name: lines.select(F.col("id").alias(f"r{end}"), F.col("at").alias(f"at_{end}"), F.col("s").alias(name))
        close = materialise(places, "close").join(own("a", "x"), ["ra", "at_a"]).join(own("b", "y"), ["rb", "at_b"]).where("x <> y")
    else:
        near = near or (lambda x, y: T.jaccard(T.stems(x), T.stems(y)))
        own = lambda end, name: texts.select(F.col("id").alias(f"r{end}"), F.col("ss").alias(name))
        both = both.join(own("a", "sa"), "ra").join(own("b", "sb"), "rb")
        both = both.select("ra", "rb", F.explode("sa").alias("x"), "sb").select("ra", "rb", "x", F.explode("sb").alias("y")).where("x <> y")
        close = both.withColumn("score", near(F.col("x"), F.col("y"))).where(F.col("score") >= anchor)
    # tokens are written before they are compared: a lambda would make them anew for each word, and a filter the whole difference
    close = materialise(close.select("ra", "rb", "x", "y", "score", T.claim_tokens(F.col("x")).alias("cx"), T.claim_tokens(F.col("y")).alias("cy")), "close")
    found = materialise(close.select("ra", "rb", "x", "y", "score", T.content_diff(F.col("cx"), F.col("cy")).alias("differ")), "found")
    return pairs.join(found.where(F.size("differ") > 0), ["ra", "rb"]).select(F.col("a").alias("older"), F.col("b").alias("newer"), "x", "y", "score", "differ")


def sweep(nodes: DataFrame, candidates: Callable[[DataFrame], DataFrame], adjudicate: Callable[[Column, Column], Column], anchor: float = 0.8, threshold: float = 0.5, cursor: int = -1) -> tuple[DataFrame, int]:
    """(older, newer, reason, probability) of nodes(id, content), at most one row for each pair, and the new cursor.

    ``candidates`` gives pairs(a, b) of nodes; of a pair the most similar anchored sentences are adjudicated, ties to the first
    in order."""
    pairs = candidates(nodes).where(F.greatest("a", "b") > cursor).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = evidence(pairs, nodes.select("id", T.sentences(F.col("content")).alias("ss")), anchor)
    best = found.groupBy("older", "newer").agg(F.min(F.struct((-F.col("score")).alias("s"), "x", "y", "differ")).alias("e"))
    judged = best.select("older", "newer", F.concat_ws(" ", "e.differ").alias("reason"), adjudicate(F.col("e.x"), F.col("e.y")).alias("probability"))
    last = nodes.agg(F.max("id")).first()[0]
    return judged.where(F.col("probability") >= threshold), cursor if last is None else max(cursor, last)


def firewall(cited: DataFrame, nodes: DataFrame, least: float = 0.2) -> DataFrame:
    """cited(line, id, cited) with ok: the node of nodes(id, channel, content) exists, has the cited channel, and shares at least
    that part of the line's stems."""
    both = cited.join(nodes, "id", "left")
    own = T.stems(F.regexp_replace("line", r"\[mem:[^\]]*\]$", ""))
    share = F.size(F.array_intersect(own, T.stems(F.col("content")))) / F.greatest(F.size(own), F.lit(1))
    return both.withColumn("ok", F.coalesce((F.col("channel") == F.col("cited")) & (share >= least), F.lit(False)))
