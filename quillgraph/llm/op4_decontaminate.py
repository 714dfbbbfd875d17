"""Benchmark decontamination: edit-tolerant search for benchmark items in whole texts.

Similarity of an item of L words and a window of L words of a text is ``1 - edit distance / L`` over words.

1. Sound filter: a window within distance d of an item shares at least ``L - 1 - 2 d`` of its word bigrams with it (each edit
   touches two). Only windows with that many bigrams of items of their size go on; all positions of all texts are counted.
2. The same count for each single item: in the stretches left, the positions of every item's own bigrams are listed, and a
   window is a candidate for an item if it holds ``L - 1 - 2 d`` of that item's. Nothing at the threshold is lost.
3. Candidates are verified by their exact edit distance, those that share most first; one that shares s bigrams is at distance
   ``(L - 1 - s) / 2`` at least, so those that cannot be the best window of their text and item are left out. Windows of the
   same words are verified once for each text.

Items of fewer than ``LEAST_WORDS`` words are too short for a similarity below one: they must occur word by word, and are
looked up by the hash of as many words.

The items are a constant of proven size: they are read in chunks of at most ``CHUNK_CHARS`` characters, each with a pass over
the texts of its own, so any number of items works. Nothing is shuffled: ``find_items`` reports the windows, ``drop_contaminated``
passes whole rows through the same search and keeps those without one.

Defined results: items without a word, null items and null texts match nothing; repeated items are each reported; rows with
equal or null ids are each reported, or dropped, for themselves; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import bounded_batches
from . import textvec
from .words import column_slices, releasing, text_slices

SIMILARITY, LEAST_WORDS = 0.8, 5
CHUNK_CHARS = 16_000_000
OUT = "doc_id long, item_id long, start_word long, start_char long, end_char long, distance long, similarity double"
_SLICE, _AT_ONCE = 500_000, 2_000_000
_MULT = np.uint64(0xA24BAED4963EE407)


def places(words: np.ndarray) -> dict[int, int]:
    """Bits of the positions of each word."""
    out: dict[int, int] = {}
    for k, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << k
    return out


def edit_distance(at: dict[int, int], length: int, other: list[int]) -> int:
    """Edit distance of a word sequence, given by ``places``, and another one, by bit-parallel dynamic programming."""
    full, last = (1 << length) - 1, 1 << length - 1
    up, down, score = full, 0, length
    for w in other:
        equal = at.get(w, 0)
        diagonal = equal | down
        across = (((equal & up) + up) ^ up) | equal
        rise, fall = down | ~(across | up) & full, up & across
        score += bool(rise & last) - bool(fall & last)
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        up, down = fall | ~(diagonal | rise) & full, rise & diagonal
    return score


class Items:
    """A chunk of benchmark items, prepared for windows of their sizes."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float):
        w = textvec.words([t for _, t in rows])
        by_length: dict[int, list[int]] = {}
        for k, n in enumerate(np.diff(w.first).tolist()):
            if n >= LEAST_WORDS:
                by_length.setdefault(n, []).append(k)
        self.short = self._short(rows, w)
        self.groups, self.owners, grams = [], [], []
        for n, own in sorted(by_length.items()):
            words = np.stack([w.hash[w.first[k] : w.first[k] + n] for k in own])
            most = math.floor((1 - similarity) * n + 1e-9)
            own_grams, gram = np.unique(self.bigrams(words), return_inverse=True)
            self.groups.append((n, most, max(1, n - 1 - 2 * most), [rows[k][0] for k in own], words, own_grams))
            self.owners.append(np.unique(gram.reshape(len(own), n - 1) * len(own) + np.arange(len(own))[:, None]))  # bigram, item
            grams.append(own_grams)
        self.grams = np.unique(np.concatenate(grams)) if grams else np.zeros(0, dtype=np.uint64)
        self.bitmap = np.zeros(1 << 22, dtype=bool)
        self.bitmap[self.grams >> np.uint64(42)] = True
        self.least = self.groups[0][0] if self.groups else 0
        # some stretch of the shortest size inside a matching window holds this many shared bigrams
        self.dense = min((math.ceil(need / math.ceil((n - 1) / (self.least - 1))) for n, _, need, *_ in self.groups), default=0)
        self.places = [[places(x) for x in g[4]] for g in self.groups]

    @staticmethod
    def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
        """Hash of each run of n words."""
        code = np.zeros(max(0, len(hashes) - n + 1), dtype=np.uint64)
        for k in range(n):
            code = code * _MULT + hashes[k : k + len(code)]
        return textvec.mix(code)

    def _short(self, rows: list[tuple[int, str]], w: textvec.Words) -> list[tuple[int, np.ndarray, list[list[int]]]]:
        """(words, sorted codes, item ids of each code) of the items below the least length."""
        out = []
        for n in range(1, LEAST_WORDS):
            by_code: dict[int, list[int]] = {}
            for k in np.flatnonzero(np.diff(w.first) == n).tolist():
                by_code.setdefault(int(self._runs(w.hash[w.first[k] : w.first[k] + n], n)[0]), []).append(rows[k][0])
            if by_code:
                out.append((n, np.array(sorted(by_code), dtype=np.uint64), [by_code[c] for c in sorted(by_code)]))
        return out

    def _verbatim(self, w: textvec.Words) -> Iterator[tuple[int, int, int, int]]:
        """(text, item id, words, first word) of the first place of each short item in each text."""
        for n, codes, owners in self.short:
            run = self._runs(w.hash, n)
            if not len(run):
                continue
            at = np.flatnonzero(self._among(run, codes) & (w.doc[: len(run)] == w.doc[n - 1 :]))
            item = np.searchsorted(codes, run[at])
            one = np.unique(w.doc[at] * len(codes) + item, return_index=True)[1]
            for f, c in zip(at[one].tolist(), item[one].tolist(), strict=True):
                for item_id in owners[c]:
                    yield int(w.doc[f]), item_id, n, f

    @staticmethod
    def bigrams(words: np.ndarray) -> np.ndarray:
        return textvec.mix(words[..., :-1] * np.uint64(0x9FB21C651E98DF25) + words[..., 1:])

    @staticmethod
    def _among(code: np.ndarray, known: np.ndarray) -> np.ndarray:
        return known[np.minimum(np.searchsorted(known, code), len(known) - 1)] == code

    @staticmethod
    def _spread(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
        """lo, lo + 1, ... of each size, one after the other."""
        return np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum())) if len(size) else lo

    def candidates(self, w: textvec.Words) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(group, item, first word, shared bigrams) of the windows that share enough bigrams with an item of their size."""
        if not self.groups or len(w.hash) < self.least:
            return
        code = self.bigrams(w.hash)
        hit = self.bitmap[code >> np.uint64(42)] & (w.doc[1:] == w.doc[:-1])
        at = np.flatnonzero(hit)
        at = at[self._among(code[at], self.grams)]
        hit = np.zeros(len(w.hash), dtype=np.int32)
        hit[at] = 1
        run = np.r_[0, np.cumsum(hit)]
        span = self.least - 1
        crowded = np.flatnonzero(run[span:] - run[:-span] >= self.dense)
        use = np.zeros(len(w.first), dtype=bool)
        use[w.doc[np.minimum(crowded, len(w.doc) - 1)]] = True
        at = at[use[w.doc[at]]]
        wide = len(w.hash) + 1
        for g, ((n, _, need, _, words, own), owners) in enumerate(zip(self.groups, self.owners, strict=True)):
            mine = at[self._among(code[at], own)]
            if len(mine) < need:
                continue
            # only stretches with enough bigrams of any item of the size
            ok = np.flatnonzero((mine[need - 1 :] - mine[: len(mine) - need + 1] <= n - 2) & (w.doc[mine[need - 1 :]] == w.doc[mine[: len(mine) - need + 1]]))
            edge = np.bincount(np.searchsorted(mine, mine[ok + need - 1] - n + 2), minlength=len(mine) + 1)
            edge -= np.bincount(np.searchsorted(mine, mine[ok] + n - 1), minlength=len(mine) + 1)
            mine = mine[np.cumsum(edge[:-1]) > 0]
            if not len(mine):
                continue
            base, m = np.searchsorted(own, code[mine]) * len(words), len(words)
            total = int((np.searchsorted(owners, base + m) - np.searchsorted(owners, base)).sum())
            step = max(1, m // math.ceil(total / _AT_ONCE))  # a bounded number of positions at once
            for a in range(0, m, step):
                lo = np.searchsorted(owners, base + a)
                size = np.searchsorted(owners, base + min(m, a + step)) - lo
                held = np.sort(owners[self._spread(lo, size)] % m * wide + np.repeat(mine, size))  # item, position
                if len(held) < need:
                    continue
                head, tail = held[: len(held) - need + 1], held[need - 1 :]
                # a window holds positions head .. tail: its first word is between tail - n + 2 and head
                near = tail - head <= n - 2
                head, tail = head[near], tail[near]
                near = (head // wide == tail // wide) & (w.doc[head % wide] == w.doc[tail % wide])
                head, tail = head[near], tail[near]
                doc, item = w.doc[head % wide], head // wide
                lo = np.maximum(tail % wide - n + 2, w.first[doc])
                hi = np.minimum(head % wide, w.first[doc + 1] - n)
                window = np.unique(self._spread(item * wide + lo, np.maximum(hi - lo + 1, 0)))
                if len(window):
                    yield g, window // wide, window % wide, np.searchsorted(held, window + n - 1) - np.searchsorted(held, window)

    def search(self, texts) -> list[tuple]:
        """(text number, item id, first word, start, end, distance, similarity): the best window of each text and item."""
        slices = ((a, b, texts[a:b]) for a, b in text_slices(texts, _SLICE)) if isinstance(texts, list) else column_slices(texts, _SLICE)
        best: dict[tuple[int, int, int], tuple] = {}
        for a, _, part in slices:
            w = textvec.words(part)
            for d, item_id, n, f in self._verbatim(w):
                best[a + d, item_id, n] = (0, f - int(w.first[d]), int(w.start[f]), int(w.end[f + n - 1]))
            if not self.groups:
                continue
            p, inverse = textvec._powers(len(w.hash) + 1)
            total = np.r_[np.uint64(0), np.cumsum(w.hash * p[: len(w.hash)], dtype=np.uint64)]
            for g, item, first, shared in self.candidates(w):
                n, most, _, ids, _, _ = self.groups[g]
                content = textvec.mix((total[first + n] - total[first]) * inverse[first])
                code = textvec.mix(content + textvec.mix(w.doc[first].astype(np.uint64) * np.uint64(len(ids)) + item.astype(np.uint64)))
                one = np.unique(code, return_index=True)[1]  # the first of equal windows
                item, first, least = item[one], first[one], np.maximum(0, n - shared[one]) // 2
                order = np.lexsort((first, least))
                for it, f, bound in zip(item[order].tolist(), first[order].tolist(), least[order].tolist(), strict=True):
                    d = int(w.doc[f])
                    name, word = (a + d, ids[it], n), f - int(w.first[d])
                    if name in best and (bound, word) >= best[name][:2]:
                        continue
                    distance = edit_distance(self.places[g][it], n, w.hash[f : f + n].tolist())
                    if distance <= most:
                        value = (distance, word, int(w.start[f]), int(w.end[f + n - 1]))
                        if name not in best or value < best[name]:
                            best[name] = value
        return [(doc, item, word, start, end, distance, 1 - distance / n) for (doc, item, n), (distance, word, start, end) in sorted(best.items())]


def _search(shared, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(shared.value, similarity)
        schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("distance", pa.int64()), ("similarity", pa.float64())])
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            found = items.search(texts)
            if found:
                columns = list(zip(*found, strict=True))
                columns[0] = [ids[d] for d in columns[0]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    return releasing(run)


def _clean(shared, similarity: float, text: str):
    """Rows without any item, all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(shared.value, similarity)
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            keep[[f[0] for f in items.search(batch.column(text).cast(pa.string()))]] = False
            yield batch.filter(pa.array(keep))

    return releasing(run)


def _chunks(benchmark: DataFrame, chunk_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items, in lists of about half of chunk_chars characters."""
    items = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    chunks = max(1, math.ceil(2 * chars / chunk_chars))
    for k in range(chunks):
        yield sorted((r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == k).collect())


def find_items(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """The best window for each pair of a document (doc_id, text) and a benchmark item (item_id, text) at the similarity."""
    bounded_batches(docs.sparkSession)
    broadcast = docs.sparkSession.sparkContext.broadcast
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = [docs.mapInArrow(_search(broadcast(own), similarity), OUT) for own in _chunks(benchmark, chunk_chars)]
    return functools.reduce(DataFrame.union, found)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """The rows of docs whose text holds no benchmark item at the similarity; all columns stay as they are."""
    bounded_batches(docs.sparkSession)
    broadcast = docs.sparkSession.sparkContext.broadcast
    for own in _chunks(benchmark, chunk_chars):
        docs = docs.mapInArrow(_clean(broadcast(own), similarity, "text"), docs.schema)
    return docs


def op4_decontaminate(spark, sf_dir):
    return find_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
