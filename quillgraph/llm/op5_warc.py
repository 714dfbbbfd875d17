"""WARC archives: a Python data source that writes and reads ``.warc.gz`` files.

Writing: one gzip member for each record, so any record can be read alone. The member's header has an ``sl`` extra field
(compressed and full length), which lets a reader step over a member without inflating it. Records with equal payloads of at
least ``MIN_DEDUP`` bytes: the smallest page id is the ``response``, all others are ``revisit`` records without the payload.

Planning: digests are counted first, and the table of those with copies is written. Up to ``SMALL`` rows it is broadcast, and no
payload moves before the writer; beyond that rows meet it by digest and one of ``SALTS`` salts, so the payloads of one very
common page are dealt to many tasks. Payloads below ``MIN_DEDUP`` bytes take part in neither.

Reading: partitions are planned by file and, in files of more than ``SPLIT`` bytes, by the record offsets that the manifest
lists; equality and IN predicates on ``record_type`` and on header columns are pushed down. Of each member the reader inflates
the first bytes, parses the headers, and inflates the payload only if the record passes and the requested schema has the
``payload`` column. Both sides work one payload, or ``HELD`` bytes of them, at a time.

Defined results: a null payload is empty; a null url has no header; control characters in urls are percent-encoded; a null
page id has no header and reads back as null (it sorts after all others when a response is chosen); rows with the same page
id are all written, and of equal payloads with the same smallest id exactly one is the response, that of the least url; record
ids are unique whatever the page ids; an empty table gives an archive without records; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from ..shared import bounded_batches, materialise, shared_path
from .files import Folder
from .words import release

NAME = "quill_warc"
MIN_DEDUP = 100
SCHEMA = "page_id long, record_type string, url string, payload_digest string, payload_bytes long, refers_to long, payload binary"
_ARROW = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
_DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FIRST = 4096
#: Rows of the table of copied digests that are broadcast (under 100 bytes each), and salts of the join beyond that.
SMALL, SALTS = 200_000, 32
#: Bytes of payloads that a reader holds, and bytes of a file that one reader takes.
HELD, SPLIT = 8 << 20, 64 << 20


def _urn(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _safe(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in url)


def record(name: str, page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A whole WARC/1.1 record, uncompressed. ``name`` tells it from all others; a response that has copies goes by its digest."""
    own = name if revisit or size < MIN_DEDUP else f"payload:{digest}"
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(own)), ("WARC-Date", _DATE), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(size))]
    head += [("X-Page-Id", str(page_id))] if page_id is not None else []
    head += [("WARC-Target-URI", _safe(url))] if url is not None else []
    head += [("WARC-Refers-To", _urn(f"payload:{digest}")), ("WARC-Profile", _PROFILE)] if revisit else []
    head += [("X-Refers-To-Page", str(refers_to))] if revisit and refers_to is not None else []
    block = _HTTP % size + (b"" if revisit else payload)
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    """A gzip member with its lengths in an ``sl`` extra field."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 24 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    files: list = field(default_factory=list)


class WarcWriter(DataSourceArrowWriter):
    """Takes page_id, url, payload, size, digest, refers_to, revisit."""

    def __init__(self, options: dict):
        self.uri, self.roll = options["path"], int(options.get("rollbytes", 1 << 30))
        self.split = int(options.get("splitbytes", SPLIT))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task, folder, done, out = TaskContext.get(), Folder(self.uri), [], None
        folder.create()
        for batch in iterator:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "size", "digest", "refers_to", "revisit")]
            for k in range(batch.num_rows):
                page_id, url, payload, size, digest, refers_to, revisit = (c[k].as_py() for c in columns)
                if out is None:
                    done.append({"part": task.partitionId(), "name": f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.warc.gz", "bytes": 0, "records": 0, "cuts": [0]})
                    out = folder.write(done[-1]["name"])
                now = done[-1]
                if now["bytes"] - now["cuts"][-1] >= self.split:
                    now["cuts"].append(now["bytes"])
                packed = member(record(f"{self.uri}/{now['name']}:{now['records']}", page_id, url, payload or b"", size, digest, refers_to, revisit))
                out.write(packed)
                now["bytes"] += len(packed)
                now["records"] += 1
                if now["bytes"] >= self.roll:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        release()
        return Written(done)

    def commit(self, messages: list) -> None:
        Folder(self.uri).publish(sorted((f for m in messages if m for f in m.files), key=lambda f: f["name"]))

    def abort(self, messages: list) -> None:
        Folder(self.uri).drop(f["name"] for m in messages if m for f in m.files)


class Member:
    """A gzip member at the file's position: the first bytes at once, the rest on demand, or none of it."""

    def __init__(self, f, at: int):
        self.f, self.at = f, at
        f.seek(at)
        raw = f.read(24)
        self.end = at >= f.size() or len(raw) < 18
        if self.end:
            return
        if raw[:4] != b"\x1f\x8b\x08\x04" or raw[12:14] != b"sl":
            raise ValueError(f"a gzip member without its lengths at {at}")
        self.size = struct.unpack_from("<I", raw, 16)[0]
        self.next = at + self.size
        self.inflate = zlib.decompressobj(-15)
        f.seek(at + 24)
        self.left = self.size - 24 - 8
        self.data = b""
        self.grow(_FIRST)

    def grow(self, n: int | None = None) -> bytes:
        """Inflate ``n`` compressed bytes more, or all."""
        n = self.left if n is None else min(n, self.left)
        self.data += self.inflate.decompress(self.f.read(n))
        self.left -= n
        return self.data

    def headers(self) -> dict[str, str]:
        while (cut := self.data.find(b"\r\n\r\n")) < 0 and self.left:
            self.grow(_FIRST)
        self.body_at = cut + 4
        lines = self.data[:cut].decode().split("\r\n")[1:]
        return dict(line.split(": ", 1) for line in lines)

    def payload(self, block_bytes: int) -> bytes:
        block = self.grow()[self.body_at : self.body_at + block_bytes]
        return block[block.index(b"\r\n\r\n") + 4 :]


@dataclass
class WarcFile(InputPartition):
    name: str
    start: int = 0
    stop: int = 0


class WarcReader(DataSourceReader):
    PUSHED = ("record_type", "page_id", "url", "payload_digest", "payload_bytes", "refers_to")

    def __init__(self, options: dict, fields: list[str]):
        self.uri, self.fields, self.wanted = options["path"], fields, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for x in filters:
            if isinstance(x, EqualTo | In) and len(x.attribute) == 1 and x.attribute[0] in self.PUSHED:
                # equality with null is never true: a null in the list matches no row, least of all one without the value
                self.wanted.append((x.attribute[0], {v for v in ([x.value] if isinstance(x, EqualTo) else x.value) if v is not None}))
            else:
                yield x

    def partitions(self) -> list:
        return [WarcFile(e["name"], a, b) for e in Folder(self.uri).entries() for a, b in zip(e["cuts"], [*e["cuts"][1:], e["bytes"]], strict=True)] or [WarcFile("")]

    def read(self, partition: WarcFile):
        schema = pa.schema([_ARROW.field(n) for n in self.fields])
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        rows, held = [], 0
        if partition.name:
            with Folder(self.uri).read(partition.name) as f:
                at = partition.start
                while at < partition.stop:
                    m = Member(f, at)
                    at = m.next
                    head = m.headers()
                    number = lambda k, head=head: int(head[k]) if k in head else None
                    row = {"page_id": number("X-Page-Id"), "record_type": head["WARC-Type"], "url": head.get("WARC-Target-URI"), "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha256:"), "payload_bytes": number("X-Payload-Length"), "refers_to": number("X-Refers-To-Page")}
                    if all(row[k] is not None and row[k] in values for k, values in self.wanted):
                        if "payload" in self.fields:
                            row["payload"] = m.payload(int(head["Content-Length"])) if row["record_type"] == "response" else None
                            if row["payload"] is not None and hashlib.sha256(row["payload"]).hexdigest() != row["payload_digest"]:
                                raise ValueError(f"damaged payload of page {row['page_id']}")
                            held += len(row["payload"] or b"")
                        rows.append([row[n] for n in self.fields])
                    if len(rows) >= 10_000 or held > HELD:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)
        release()


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options), schema.fieldNames())

    def writer(self, schema, overwrite: bool):
        return WarcWriter(dict(self.options))


def plan_records(pages: DataFrame, small: int = SMALL) -> DataFrame:
    """(page_id, url, payload, size, digest, refers_to, revisit) of pages(page_id, url, html); revisits carry no payload."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    rows = rows.select("page_id", "url", "payload", F.octet_length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("digest"))
    each = rows.where(F.col("size") >= MIN_DEDUP).groupBy("digest", "page_id").agg(F.count("*").alias("m"))
    least = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), F.col("page_id").alias("first_id"), F.col("m").alias("m")))
    first = each.groupBy("digest").agg(F.sum("m").alias("c"), least.alias("f")).where("c > 1").select("digest", "f.first_id", F.col("f.m").alias("tied"))
    first = materialise(first, "op5-copied")
    n, tied = first.agg(F.count("*"), F.coalesce(F.max("tied"), F.lit(0))).first()
    if n <= small:
        joined = rows.join(F.broadcast(first), "digest", "left")
    else:
        salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        large = rows.where(F.col("size") >= MIN_DEDUP).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        joined = large.join(salted, ["digest", "salt"], "left").drop("salt")
        joined = joined.unionByName(rows.where(F.col("size") < MIN_DEDUP), allowMissingColumns=True)
    is_first = F.col("page_id").eqNullSafe(F.col("first_id"))
    copied = F.coalesce(F.col("tied") > 0, F.lit(False)) & (F.col("size") >= MIN_DEDUP)
    revisit = copied & ~is_first
    out = ["page_id", "url", "payload", "size", "digest", "refers_to", "revisit"]

    def finished(df: DataFrame, revisit) -> DataFrame:
        return df.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "size", "digest", F.when(revisit, F.col("first_id")).alias("refers_to"), revisit.alias("revisit")).select(out)

    several = copied & is_first & (F.col("tied") > 1)
    if tied <= 1:
        return finished(joined, revisit)
    # rows that equal the response in payload and id: counted by url, of the least url the first is the response
    same = joined.where(several).groupBy("digest", "page_id", "first_id", "url", "size").agg(F.count("*").alias("m"), F.first("payload").alias("payload"))
    urls = same.groupBy("digest").agg(F.min(F.struct(F.col("url").isNotNull().alias("has"), F.col("url").alias("url"))).alias("u")).select(F.col("digest").alias("_d"), F.col("u.url").alias("_u"))
    same = same.join(urls, (F.col("digest") == F.col("_d")) & F.col("url").eqNullSafe(F.col("_u")), "left").withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    return finished(joined.where(~several), revisit).unionByName(finished(same, ~((F.col("k") == 1) & F.col("_d").isNotNull())))


def write_warc(pages: DataFrame, path: str, **options) -> None:
    """Write an archive of pages(page_id, url, html) below ``path``."""
    bounded_batches(pages.sparkSession)
    pages.sparkSession.dataSource.register(Warc)
    plan_records(pages).write.format(NAME).options(**options).mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of an archive. Without ``payload`` the reader never inflates more than a record's head.

    Pushdown into Python sources is a session setting; it is turned on and stays on, as plans are made later than this call."""
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    schema = SCHEMA if payload else SCHEMA.replace(", payload binary", "")
    return spark.read.format(NAME).schema(schema).load(path)


def op5_warc(spark, sf_dir):
    path = shared_path(spark, "op5-warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    back = read_warc(spark, path)
    # a response proves its own payload; a revisit has what its record says of the payload it stands for
    size = F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    digest = F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(F.col("payload_digest"))
    return back.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS b FROM pages),
d AS (SELECT page_id, strlen(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN f.first_id IS NULL OR f.first_id = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first_id IS NULL OR f.first_id = d.page_id THEN NULL ELSE f.first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
