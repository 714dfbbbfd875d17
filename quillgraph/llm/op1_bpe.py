"""BPE encoding and decoding through a distinct-word table.

1. Texts are split into words, and each block of documents (a few MB of text) keeps its distinct words once. Only those
   travel: rows (block, bucket, words), where the bucket is a hash of the word.
2. A bucket meets the words of all blocks, sorted by bucket, so each distinct word of the corpus is encoded once, in one
   task; every block gets the ids of its words back.
3. The blocks' word positions (compressed codes, not texts) join those ids by block; ids come back by position. Decoding
   joins the ids of distinct words with the id-to-piece table, whose size is the vocabulary's.

A frequent word is one entry for each block, not one for each occurrence, so no key gets hot. Both uses of step 1 must
see the same blocks: they scan the same files in the same splits, and the block's key holds a digest of its content, so a
mismatch ends in an error, never in wrong ids.

Defined results: a null or empty text has no tokens and decodes to an empty text; rows with equal ids are separate; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import bounded_batches
from .words import codec, column_slices, release_if_large, releasing

OUT = "doc_id long, n_tokens long, ids binary, decoded string"
#: Bytes of text in a block.
BLOCK_CHARS = 4_000_000


def _pack(a: np.ndarray) -> bytes:
    """Low and high halves apart, each compressed: most codes are small."""
    a = np.ascontiguousarray(a, dtype="<u4")
    halves = [(a & 0xFFFF).astype("<u2").tobytes(), (a >> 16).astype("<u2").tobytes()]
    packed = [pa.compress(h, "zstd", asbytes=True) if h else b"" for h in halves]
    return np.array([len(a), len(packed[0])], dtype="<u8").tobytes() + packed[0] + packed[1]


def _unpack(data: bytes) -> np.ndarray:
    n, cut = (int(x) for x in np.frombuffer(data, dtype="<u8", count=2))
    if not n:
        return np.zeros(0, dtype=np.int64)
    low, high = (np.frombuffer(pa.decompress(part, 2 * n, "zstd", asbytes=True), dtype="<u2") for part in (data[16 : 16 + cut], data[16 + cut :]))
    return low.astype(np.int64) | high.astype(np.int64) << 16


class _Codes(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _blocks(tokenizer: str, n_buckets: int, block_chars: int, codes: bool):
    """mapInArrow over (doc_id, text): the blocks' words by bucket, or their documents as codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part, number = codec(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, texts in column_slices(batch.column("text"), block_chars):
                index = _Codes()
                coded = [array("I", map(index.__getitem__, coder.split(t))) for t in texts]
                words = list(index)
                bucket = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % n_buckets for w in words), dtype=np.int64, count=len(words))
                order = np.argsort(bucket, kind="stable")
                words, bucket = [words[k] for k in order], bucket[order]
                own = ids.slice(a, b - a)
                digest = hashlib.blake2b(f"{part}:{number}:{own.to_pylist()}:".encode(), digest_size=8)
                digest.update("\n".join(words).encode("utf-8", "surrogatepass"))
                block, number = int.from_bytes(digest.digest(), "little", signed=True), number + 1
                if codes:
                    place = np.empty(len(order), dtype=np.uint32)
                    place[order] = np.arange(len(order), dtype=np.uint32)
                    counts = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
                    flat = place[np.frombuffer(b"".join(c.tobytes() for c in coded), dtype=np.uint32)]
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([own.to_pylist()], pa.list_(pa.int64())), pa.array([_pack(counts)], pa.binary()), pa.array([_pack(flat)], pa.binary())], ["block", "doc_ids", "counts", "codes"])
                elif words:
                    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                    stops = np.r_[starts[1:], len(words)]
                    joined = ["\n".join(words[x:y]) for x, y in zip(starts, stops, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(starts), pa.int64()), pa.array(bucket[starts], pa.int32()), pa.array(starts, pa.int32()), pa.array(joined, pa.string())], ["block", "bucket", "start", "words"])

    return releasing(run)


def _encode(tokenizer: str):
    """mapInArrow over rows sorted by bucket: each distinct word of a bucket is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, current, known = codec(tokenizer), None, {}
        for batch in batches:
            for block, bucket, start, joined in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "start", "words")), strict=True):
                if bucket != current:
                    current, known = bucket, {}
                words = joined.split("\n")
                new = [w for w in words if w not in known]
                known.update(zip(new, coder.encode_words(new), strict=True))
                coded = [known[w] for w in words]
                counts = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)) // coder.dtype.itemsize
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([start], pa.int32()), pa.array([_pack(counts)], pa.binary()), pa.array([b"".join(coded)], pa.binary())], ["block", "start", "counts", "ids"])

    return releasing(run)


def _assemble(tokenizer: str):
    """Cogroup of one block: ids by position, then pieces by id."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        coder = codec(tokenizer)
        if left.num_rows != 1:
            raise ValueError("a block's words without its documents: the two scans of the input differ")
        parts = sorted(zip(right.column("start").to_pylist(), right.column("counts").to_pylist(), right.column("ids").to_pylist(), strict=True))
        lens = np.concatenate([np.zeros(0, dtype=np.int64), *(_unpack(p[1]) for p in parts)])
        table = np.frombuffer(b"".join(p[2] for p in parts), dtype=coder.dtype)
        codes, counts = _unpack(left.column("codes")[0].as_py()), _unpack(left.column("counts")[0].as_py())
        if len(codes) and int(codes.max()) >= len(lens):
            raise ValueError("a block's documents without all its words: the two scans of the input differ")
        first = np.r_[0, np.cumsum(lens)]
        n = lens[codes]
        ends = np.cumsum(n)
        at = np.repeat(first[codes] - (ends - n), n) + np.arange(int(n.sum()))
        ids = table[at].astype("<u4")
        if not hasattr(coder, "piece_table"):
            coder.piece_table = pa.array(coder.pieces())
        pieces = coder.piece_table.take(pa.array(table, pa.int32())).to_pylist()
        word_text = [" ".join(pieces[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        stops = np.cumsum(counts)
        tokens = np.r_[0, ends][np.r_[0, stops]]
        code_list, out_ids, decoded = codes.tolist(), [], []
        for k, (a, b) in enumerate(zip((stops - counts).tolist(), stops.tolist(), strict=True)):
            out_ids.append(ids[tokens[k] : tokens[k + 1]].tobytes())
            decoded.append(" ".join([word_text[c] for c in code_list[a:b]]))
        if coder.tok.decoder is not None:
            decoded = [coder.tok.decode(np.frombuffer(x, dtype="<u4").tolist(), skip_special_tokens=False) for x in out_ids]
        del at, ids, table, parts, codes, code_list, word_text
        release_if_large()
        return pa.table([left.column("doc_ids")[0].values, pa.array(np.diff(tokens)), pa.array(out_ids, pa.binary()), pa.array(decoded, pa.string())], schema=schema)

    return run


def encode_decode(docs: DataFrame, tokenizer: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of docs(doc_id, text); ids are little-endian u32."""
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    n_buckets = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = rows.mapInArrow(_blocks(tokenizer, n_buckets, block_chars, codes=False), "block long, bucket int, start int, words string")
    encoded = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_encode(tokenizer), "block long, start int, counts binary, ids binary")
    coded = rows.mapInArrow(_blocks(tokenizer, n_buckets, block_chars, codes=True), "block long, doc_ids array<long>, counts binary, codes binary")
    return coded.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(_assemble(tokenizer), OUT)


def op1_bpe(spark, sf_dir):
    import public_tokenizers

    out = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
