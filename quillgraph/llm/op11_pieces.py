"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies with byte fallback.

1. A text is normalised by the library and cut into segments: before each white-space mark that follows another character, and
   between letters and other characters. No merge can cross a cut, as no piece of the vocabulary does; a vocabulary with pieces
   that do is cut at fewer places or not at all.
2. A segment is encoded by an agenda of its adjacent symbol pairs, by score, then by position. The best pair merges, and its
   neighbours offer new pairs. What is no piece becomes bytes. The agendas of all new short segments of a batch run side by side in
   array operations; that of a long one is a heap, in which a pair is stale once one of its symbols has grown or gone.
   Segments repeat, so a worker keeps the ids of short ones, up to a bound.
3. Ids are decoded piece by piece: marks become spaces, the one that encoding puts in front goes, runs of byte pieces become text.
4. Each Arrow batch is checked against the sentencepiece library: the segments that are new to the worker in one call, or (as an
   option) its whole texts, encoded and decoded. A difference ends the job.

Each text is for itself, so nothing is shuffled and no key is hot; memory is bounded by a slice of texts and its longest text.

Defined results: a null or empty text has no tokens and decodes to an empty text; repeated rows and equal or null ids are
separate rows; an empty table gives an empty result; other columns are ignored; null ids decode to an empty text.
"""

from __future__ import annotations

import codecs
import heapq
import itertools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import bounded_batches
from .words import column_slices, releasing

MARK = "▁"
#: Bytes of text that are encoded at once, segments whose ids are kept (in each of two halves), longest segment that is kept and
#: encoded beside others, and how many are at once.
SLICE, KEEP, SHORT, AT_ONCE = 4_000_000, 1_000_000, 48, 50_000
_NEVER = float("inf")


_LETTER, _OTHER = r"[^\W\d_]", rf"(?:[\d_]|[^\w{MARK}])"
#: Segments, finest first, and what a piece must not hold for them to be independent.
_CUTS = [
    (rf"{MARK}*{_LETTER}+|{MARK}*{_OTHER}+|{MARK}+", rf"[^{MARK}]{MARK}|{_LETTER}{_OTHER}|{_OTHER}{_LETTER}"),
    (rf"{MARK}*[^{MARK}]+|{MARK}+", f"[^{MARK}]{MARK}"),
    (r"(?s:.+)", r"(?!)"),
]
#: A character that no piece holds beside others (its byte piece stands for it), so it keeps segments apart in one call of the library.
_APART = "\x00"


def _one_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("quillgraph-one-byte", _one_byte)


class Pieces(dict):
    """The vocabulary of a model file, and (as a mapping) the ids of the segments seen, as little-endian integers."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp, n = self.library, self.library.get_piece_size()
        names = [sp.id_to_piece(k) for k in range(n)]
        self.control = np.array([sp.is_control(k) for k in range(n)])
        plain = [k for k in range(n) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))]
        self.known = {names[k]: k for k in plain}
        #: What a pair that makes this piece costs on the agenda: the best score comes first.
        self.cost = {names[k]: -sp.get_score(k) for k in plain}
        by_byte = {int(names[k][3:5], 16): k for k in range(n) if sp.is_byte(k)}
        if len(by_byte) < 256:
            raise ValueError("only vocabularies with byte fallback are covered")
        self.byte_ids = [by_byte[b] for b in range(256)]
        raw = {k: bytes([b]) for b, k in by_byte.items()}
        self.raw = [raw.get(k, b"" if sp.is_control(k) else " ⁇ ".encode() if sp.is_unknown(k) else names[k].replace(MARK, " ").encode()) for k in range(n)]
        self.marked = [k not in raw and names[k].startswith(MARK) for k in range(n)]
        self.segments = re.compile(next(p for p, crossing in _CUTS if not any(map(re.compile(crossing).search, self.known)))).findall
        self.code = "H" if n <= 1 << 16 else "I"
        self.old, self.new = {}, []
        self.size = n
        self.char_ids = np.full(0x110000, -1, dtype=np.int64)
        for name, k in self.known.items():
            if len(name) == 1:
                self.char_ids[ord(name)] = k
        known = self.known
        pairs = sorted((known[a] * n + known[b], self.cost[p], k) for p, k in known.items() for j in range(1, len(p)) if (a := p[:j]) in known and (b := p[j:]) in known)
        self.pair_key, self.pair_made = (np.array([x[j] for x in pairs] or [-1], dtype=np.int64) for j in (0, 2))
        self.pair_cost = np.array([x[1] for x in pairs] or [_NEVER])

    def agendas(self, segments: list[str]) -> list[bytes]:
        """Ids of segments, whose agendas run side by side: in each round the first of the best pairs of every segment merges."""
        if not segments:
            return []
        start = np.r_[0, np.cumsum([len(x) for x in segments])]
        own = np.repeat(np.arange(len(segments)), np.diff(start))
        text = "".join(segments)
        point = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        symbol = self.char_ids[point]
        # a character that is no piece merges with nothing and goes by its place from below
        symbol = np.where(symbol < 0, -1 - np.arange(len(symbol)), symbol)
        cost, made = self._pairs(symbol, own, np.arange(len(symbol)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            size = np.diff(np.r_[first, len(own)])
            best = np.repeat(np.minimum.reduceat(cost, first), size)
            ended = best == _NEVER
            if ended.any():
                done.append((own[ended], symbol[ended]))
                symbol, own, cost, made, best = (x[~ended] for x in (symbol, own, cost, made, best))
            at = np.flatnonzero(cost == best)
            at = at[np.r_[True, own[at[1:]] != own[at[:-1]]]] if len(at) else at
            symbol[at] = made[at]
            keep = np.ones(len(symbol), dtype=bool)
            keep[at + 1] = False
            symbol, own, cost, made = (x[keep] for x in (symbol, own, cost, made))
            at -= np.arange(len(at))  # as many symbols before each have gone
            near = np.r_[at, at[at > 0] - 1]
            cost[near], made[near] = self._pairs(symbol, own, near)
        owner, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        owner, symbol = owner[order], symbol[order]
        odd = symbol < 0
        if odd.any():
            raw = [text[-1 - k].encode("utf-8", "surrogatepass") for k in symbol[odd].tolist()]
            width = np.ones(len(symbol), dtype=np.int64)
            width[odd] = [len(x) for x in raw]
            owner, symbol, odd = np.repeat(owner, width), np.repeat(symbol, width), np.repeat(odd, width)
            symbol[odd] = np.array(self.byte_ids)[np.frombuffer(b"".join(raw), np.uint8)]
        ids = symbol.astype(self.code).tobytes()
        stop = np.searchsorted(owner, np.arange(len(segments) + 1)) * np.dtype(self.code).itemsize
        return [ids[x:y] for x, y in zip(stop[:-1].tolist(), stop[1:].tolist(), strict=True)]

    def _pairs(self, symbol: np.ndarray, own: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost and piece of the pairs that begin at these places."""
        last = at == len(symbol) - 1
        follower = np.where(last, at, at + 1)
        key = symbol[at] * self.size + symbol[follower]
        k = np.searchsorted(self.pair_key, key)
        k[k == len(self.pair_key)] = 0
        good = (self.pair_key[k] == key) & (symbol[at] >= 0) & (symbol[follower] >= 0) & ~last & (own[at] == own[follower])
        return np.where(good, self.pair_cost[k], _NEVER), np.where(good, self.pair_made[k], 0)

    def agenda(self, segment: str) -> bytes:
        """Ids of one segment of any length."""
        out = array(self.code)
        for s in self._symbols(segment):
            k = self.known.get(s)
            out.extend((self.byte_ids[x] for x in s.encode()) if k is None else (k,))
        return out.tobytes()

    def _symbols(self, segment: str) -> list[str]:
        """The agenda of one segment, a heap of its pairs."""
        symbol, n = list(segment), len(segment)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        cost, push, heap = self.cost.get, heapq.heappush, []
        for k in range(n - 1):
            c = cost(symbol[k] + symbol[k + 1])
            if c is not None:
                heap.append((c, k, k + 1, 2))
        heapq.heapify(heap)
        while heap:
            _, left, right, size = heapq.heappop(heap)
            a, b = symbol[left], symbol[right]
            if not a or not b or len(a) + len(b) != size:
                continue
            symbol[left], symbol[right] = merged, _ = a + b, ""
            after[left] = follower = after[right]
            if follower >= 0:
                before[follower] = left
                c = cost(merged + symbol[follower])
                if c is not None:
                    push(heap, (c, left, follower, size + len(symbol[follower])))
            leader = before[left]
            if leader >= 0:
                c = cost(symbol[leader] + merged)
                if c is not None:
                    push(heap, (c, leader, left, size + len(symbol[leader])))
        return [s for s in symbol if s]

    def learn(self, segments: set[str]) -> None:
        """Keep the ids of these segments at hand; those of the last half stay so if they are used again."""
        missing = []
        for x in segments:
            ids = self.old.pop(x, None)
            if ids is None:
                missing.append(x)
            else:
                self[x] = ids
        short = [x for x in missing if len(x) <= SHORT]
        self.new = [(x, self.agenda(x)) for x in missing if len(x) > SHORT]
        for k in range(0, len(short), AT_ONCE):
            part = short[k : k + AT_ONCE]
            self.new += zip(part, self.agendas(part), strict=True)
        self.update(self.new)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; each segment that is not at hand is encoded once."""
        parts = [self.segments(self.library.normalize(t)) if t else () for t in texts]
        self.learn(set(itertools.chain.from_iterable(parts)).difference(self))
        found = [np.frombuffer(b"".join(map(self.__getitem__, p)), dtype=self.code) for p in parts]
        for x, _ in self.new:
            if len(x) > SHORT:
                del self[x]
        if len(self) > KEEP:
            self.old = dict(self)
            self.clear()
        return found

    def check_new(self) -> None:
        """Compare the segments that are new since the last call with the library."""
        new, self.new = self.new, []
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            alone = [x for x in part if _APART in x[0]]
            part = [x for x in part if _APART not in x[0]]
            # a mark is put in front of the text; each segment follows a byte that nothing merges with
            ids = self.library.encode_as_numpy(_APART + _APART.join(s for s, _ in part)) if part else np.zeros(0, np.int32)
            apart = np.array([self.byte_ids[0]], dtype=self.code).tobytes()
            if ids[1:].astype(self.code).tobytes() != b"".join(apart + own for _, own in part):
                cuts = np.flatnonzero(ids == self.byte_ids[0])
                for (segment, own), a, b in zip(part, cuts, [*cuts[1:], len(ids)], strict=False):
                    if ids[a + 1 : b].astype(self.code).tobytes() != own:
                        _differ("ids", segment, np.frombuffer(own, self.code), ids[a + 1 : b])
                raise ValueError("ids of segments differ from the library's")
            if self.decode(ids) != (text := self.library.decode(ids.tolist(), num_threads=1)):
                _differ("texts", part[0][0], self.decode(ids), text)
            for segment, own in alone:
                if np.array(self.library.encode(_APART + segment)[2:], dtype=self.code).tobytes() != own:
                    _differ("ids", segment, np.frombuffer(own, self.code), "others")

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids, which must be of the vocabulary."""
        if not len(ids):
            return ""
        control = self.control[ids]
        shown = ids[~control].tolist()
        if not control.any():
            text = b"".join(map(self.raw.__getitem__, shown)).decode("utf-8", "quillgraph-one-byte")
        else:  # bytes on either side of a control id are no character
            parts = np.split(ids, np.flatnonzero(control))
            text = "".join(b"".join(map(self.raw.__getitem__, x.tolist())).decode("utf-8", "quillgraph-one-byte") for x in parts)
        return text[1:] if shown and self.marked[shown[0]] else text


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One vocabulary for each worker process and file."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _ids_column(found: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.zeros(0, np.int32), *found]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32)), pa.array(flat))


def _differ(what: str, where, own, library) -> None:
    raise ValueError(f"{what} of {where!r:.80} differ from the library's: {own!r:.80} and {library!r:.80}")


def _run(model: str, check: str | None):
    """mapInArrow over (doc_id, text): ids and decoded text of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces(model)
        for batch in batches:
            for a, b, texts in column_slices(batch.column("text"), SLICE):
                own = batch.column("doc_id").slice(a, b - a)
                found = coder.encode(texts)
                decoded = [coder.decode(x) for x in found]
                if check == "segments":
                    coder.check_new()
                elif check == "texts":
                    for doc, x, y in zip(own.to_pylist(), found, coder.library.encode([t or "" for t in texts], num_threads=1), strict=True):
                        if not np.array_equal(x, y):
                            _differ("ids", doc, x, y)
                if check == "texts":
                    for doc, s, t in zip(own.to_pylist(), decoded, coder.library.decode([x.tolist() for x in found], num_threads=1), strict=True):
                        if s != t:
                            _differ("texts", doc, s, t)
                yield pa.RecordBatch.from_arrays([own, _ids_column(found), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return releasing(run)


def encode_decode(docs: DataFrame, model: str, check: str | None = "segments") -> DataFrame:
    """(doc_id, ids array<int>, decoded) of docs(doc_id, text), without begin and end ids. ``check`` compares each batch with the
    library: its new segments, or its whole texts ("texts", which takes about twice the time), or nothing (None)."""
    if check not in ("segments", "texts", None):
        raise ValueError(f"check must be 'segments', 'texts' or None, not {check!r}")
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_run(model, check), "doc_id long, ids array<int>, decoded string")


def _decode_run(model: str, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces(model)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids = [np.array(x if x is not None else [], dtype=np.int64) for x in part.column("ids").to_pylist()]
                texts = [coder.decode(x) for x in ids]
                if check:
                    for doc, s, x in zip(part.column("doc_id").to_pylist(), texts, ids, strict=True):
                        if s != (told := coder.library.decode(x.tolist())):
                            _differ("texts", doc, s, told)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return releasing(run)


def decode(rows: DataFrame, model: str, check: bool = True) -> DataFrame:
    """(doc_id, decoded) of rows(doc_id, ids array<int>): any ids of the vocabulary, control ids (no text) and bytes that are no
    UTF-8 (U+FFFD for each) included; ids outside the vocabulary end the job."""
    bounded_batches(rows.sparkSession)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_decode_run(model, check), "doc_id long, decoded string")


def op11_sentencepiece(spark, sf_dir):
    import public_tokenizers

    out = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
