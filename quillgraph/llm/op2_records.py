"""Token-id output: length-delimited binary records with masked checksums and a separate offset index.

File format, for each record (all little-endian)::

    u64 length | u32 masked crc of those 8 bytes | data | u32 masked crc of data

where data is ``i64 document id, u8 flags (1: id is null), u8 bytes per token id, token ids``, the checksum is CRC-32 and
masking is ``((c >> 15 | c << 17) + 0xa282ead8) mod 2**32``. Beside each ``part-*.rec`` lies ``part-*.idx``: for each
record ``u64 offset, u32 bytes, u32 token ids``, so records can be read in any order. ``_manifest.json`` lists the files that
count, in document order; files of failed attempts are not in it. For each file it has cuts (record, offset, ids before) about
every ``SPLIT`` bytes, by which readers plan partitions. With the option ``seed`` the partitions come in a random order, and each
reads its part of the index and then its records in a random order.

Records are in ascending id order over all files (range partitioning, then a sort inside each partition).

Defined results: null text is empty and gives just the end id; null ids come first; rows with the same id are all written,
ordered by text; an empty table gives a manifest without records; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..shared import bounded_batches, shared_path
from .files import Folder
from .words import codec, column_slices, release

NAME, SPLIT = "framed_records", 64 << 20
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"
_HEAD, _DATA, _INDEX = struct.Struct("<QI"), struct.Struct("<qBB"), np.dtype([("offset", "<u8"), ("bytes", "<u4"), ("n", "<u4")])


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    data = _DATA.pack(doc_id or 0, doc_id is None, width) + ids
    size = struct.pack("<Q", len(data))
    return size + struct.pack("<I", masked(size)) + data + struct.pack("<I", masked(data))


def unframe(f) -> tuple[int | None, np.ndarray] | None:
    """The next record of an open file, checked; None at the end."""
    head = f.read(_HEAD.size)
    if not head:
        return None
    size, check = _HEAD.unpack(head)
    if masked(head[:8]) != check:
        raise ValueError("damaged record length")
    body = f.read(size + 4)
    if len(body) != size + 4 or masked(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
        raise ValueError("damaged record")
    doc_id, null, width = _DATA.unpack_from(body)
    return (None if null else doc_id), np.frombuffer(body, dtype=f"<u{width}", offset=_DATA.size, count=(size - _DATA.size) // width)


@dataclass
class Written(WriterCommitMessage):
    files: list = field(default_factory=list)


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.uri, self.tokenizer, self.end = options["path"], options["tokenizer"], int(options["end_id"])
        self.split = int(options.get("splitbytes", SPLIT))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task, folder, coder = TaskContext.get(), Folder(self.uri), codec(self.tokenizer)
        folder.create()
        name, out, index, at, n_ids, cuts = f"part-{task.partitionId():06d}-{task.taskAttemptId()}", None, [], 0, 0, [[0, 0, 0]]
        end = np.array([self.end], dtype=coder.dtype).tobytes()
        for batch in iterator:
            ids = batch.column("doc_id").to_pylist()
            for a, b, texts in column_slices(batch.column("text"), 4_000_000):
                for doc_id, coded in zip(ids[a:b], coder.encode(texts), strict=True):
                    out = out or folder.write(f"{name}.rec")
                    if at - cuts[-1][1] >= self.split:
                        cuts.append([len(index), at, n_ids])
                    record = frame(doc_id, coded + end, coder.dtype.itemsize)
                    n = len(coded) // coder.dtype.itemsize + 1
                    out.write(record)
                    index.append((at, len(record), n))
                    at, n_ids = at + len(record), n_ids + n
        if out is None:
            return Written()
        out.close()
        with folder.write(f"{name}.idx") as f:
            f.write(np.array(index, dtype=_INDEX).tobytes())
        release()
        return Written([{"part": task.partitionId(), "name": name, "records": len(index), "ids": n_ids, "bytes": at, "cuts": cuts}])

    def commit(self, messages: list) -> None:
        Folder(self.uri).publish(sorted((f for m in messages if m for f in m.files), key=lambda f: f["part"]))

    def abort(self, messages: list) -> None:
        Folder(self.uri).drop(f"{f['name']}.{kind}" for m in messages if m for f in m.files for kind in ("rec", "idx"))


@dataclass
class Piece(InputPartition):
    """Records first .. stop of a file, with the offset of the first and the ids of all documents before it."""

    name: str
    first: int = 0
    stop: int = 0
    offset: int = 0
    start: int = 0


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.seed = options["path"], int(options["seed"]) if "seed" in options else None

    def partitions(self) -> list:
        start, out = 0, []
        for e in Folder(self.uri).entries():
            stops = [*(c[0] for c in e["cuts"][1:]), e["records"]]
            out += [Piece(e["name"], first, stop, offset, start + ids) for (first, offset, ids), stop in zip(e["cuts"], stops, strict=True)]
            start += e["ids"]
        if self.seed is not None:
            out = [out[k] for k in np.random.default_rng(self.seed).permutation(len(out))]
        return out or [Piece("")]

    def read(self, piece: Piece):
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        rows, held, start = [], 0, piece.start
        if piece.name:
            folder = Folder(self.uri)
            order = before = None
            if self.seed is not None:
                with folder.read(f"{piece.name}.idx") as f:
                    f.seek(piece.first * _INDEX.itemsize)
                    index = np.frombuffer(f.read((piece.stop - piece.first) * _INDEX.itemsize), dtype=_INDEX)
                order = np.random.default_rng([self.seed, piece.start & 0xFFFFFFFF, piece.first]).permutation(len(index))
                before = piece.start + np.r_[0, np.cumsum(index["n"].astype(np.int64))]
            with folder.read(f"{piece.name}.rec") as f:
                f.seek(piece.offset)
                for k in range(piece.stop - piece.first):
                    if order is not None:
                        f.seek(int(index["offset"][order[k]]))
                        start = int(before[order[k]])
                    doc_id, ids = unframe(f)
                    rows.append((doc_id, start, len(ids), ids.astype("<u4").tobytes()))
                    start, held = start + len(ids), held + len(ids)
                    if held > 1_000_000:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)
        release()


class FramedRecords(DataSource):
    """``df.write.format("framed_records")`` and ``spark.read.format("framed_records")``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return RecordReader(dict(self.options))

    def writer(self, schema, overwrite: bool):
        return RecordWriter(dict(self.options))


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, **options) -> None:
    """Encode ``doc_id, text`` and write the records of all documents below ``path``."""
    bounded_batches(docs.sparkSession)
    docs.sparkSession.dataSource.register(FramedRecords)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.write.format(NAME).option("tokenizer", tokenizer).option("end_id", str(end_id)).options(**options).mode("append").save(path)


def read_records(spark: SparkSession, path: str, seed: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start counts the ids of all documents before; ids are little-endian u32. With a seed the
    records come in a random order, by the offset index."""
    spark.dataSource.register(FramedRecords)
    reader = spark.read.format(NAME)
    return (reader if seed is None else reader.option("seed", str(seed))).load(path)


class ShuffledRecords:
    """Random access through the offset index: ``len(r)``, ``r[k]``, and ``r.shuffled(seed)``."""

    def __init__(self, path: str):
        self.folder = Folder(path)
        self.entries = self.folder.entries()
        self.first = np.cumsum([0, *(e["records"] for e in self.entries)])

    def __len__(self) -> int:
        return int(self.first[-1])

    def __getitem__(self, k: int) -> tuple[int | None, np.ndarray]:
        at = int(np.searchsorted(self.first, k, side="right")) - 1
        name = self.entries[at]["name"]
        with self.folder.read(f"{name}.idx") as f:
            f.seek(int(k - self.first[at]) * _INDEX.itemsize)
            entry = np.frombuffer(f.read(_INDEX.itemsize), dtype=_INDEX)[0]
        with self.folder.read(f"{name}.rec") as f:
            f.seek(int(entry["offset"]))
            return unframe(f)

    def shuffled(self, seed: int):
        for k in np.random.default_rng(seed).permutation(len(self)):
            yield self[int(k)]


def op2_records(spark, sf_dir):
    import public_tokenizers

    path = shared_path(spark, "op2-records")
    write_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_records(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
