"""A text index that stays: postings by term bucket in a folder, extended by segments, read only where a query's terms are.

Folder: ``postings/seg=N/bucket=B`` (term, id, tf, dl), sorted by term; ``docs/seg=N`` (id, dl, h, g), one row for each row of the
input; ``drops/seg=N`` (id); ``manifest/V.json``. A row of segment s counts unless its id was dropped in a later segment. A
manifest names the segments and holds the statistics; the newest one is the index, so a writer that dies leaves files that nobody
reads. One writer at a time.

Defined results: rows with one id are documents of their own; a null id is an id like any other; null and empty texts are
documents without terms; an index of nothing finds nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import bounded_batches, shared_path
from .retrieval import Built, query_terms, word_counts

#: Buckets of an index; terms up to which the scan gets them as a list, so that row groups are skipped.
BUCKETS, LISTED = 64, 2_000
_POSTINGS, _DOCS, _DROPS = "term string, id long, tf long, dl int, seg int, bucket int", "id long, dl int, h long, g long, seg int", "id long, seg int"


class TextIndex:
    """Open with ``TextIndex(spark, folder)``; ``TextIndex.create`` makes one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.manifest = self._newest()

    @classmethod
    def create(cls, spark: SparkSession, docs: DataFrame, folder: str | None = None, buckets: int = BUCKETS) -> TextIndex:
        index = cls(spark, folder or shared_path(spark, "textindex"))
        index.manifest = {"version": -1, "buckets": buckets, "postings": [], "drops": [], "next": 0, "n": 0, "total": 0}
        index.add(docs)
        return index

    # --- files

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _newest(self) -> dict | None:
        path, fs = self._path("manifest")
        if not fs.exists(path):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        last = max((n for n in names if n.endswith(".json")), default=None)
        return json.loads(self.spark.read.text(f"{self.folder}/manifest/{last}", wholetext=True).first()[0]) if last else None

    def _publish(self, **changes) -> None:
        live = self.docs().agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).first() if "n" not in changes else None
        new = {**self.manifest, **changes, "version": self.manifest["version"] + 1}
        if live is not None:
            new |= {"n": live["n"], "total": live["total"]}
        part, fs = self._path(f"manifest/.{new['version']:09d}.part")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        if not fs.rename(part, self._path(f"manifest/{new['version']:09d}.json")[0]):
            raise OSError(f"another writer has published version {new['version']} of {self.folder}")
        self.manifest = new

    def _write(self, docs: DataFrame, seg: int) -> None:
        bounded_batches(self.spark)
        text = F.coalesce(F.col("content").cast("string"), F.lit(""))
        rows = docs.select(F.col("id").cast("long").alias("id"), text.alias("content"))
        counted = f"{self.folder}/counted/seg={seg}"
        word_counts(rows).write.parquet(counted)
        counts = self.spark.read.schema("id long, dl int, term string, tf long, h long, g long").parquet(counted)
        counts.where("term is null").select("id", "dl", "h", "g").write.parquet(f"{self.folder}/docs/seg={seg}")
        posts = counts.where("term is not null").withColumn("bucket", self._bucket(F.col("term"))).select("term", "id", "tf", "dl", "bucket")
        # a bucket with a frequent term is written by several tasks
        posts.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.folder}/postings/seg={seg}")
        path, fs = self._path(f"counted/seg={seg}")
        fs.delete(path, True)

    def _bucket(self, term) -> F.Column:
        return F.pmod(F.xxhash64(term), F.lit(self.manifest["buckets"])).cast("int")

    # --- changes

    def add(self, docs: DataFrame) -> None:
        """Index the rows of docs(id, content) beside what is there."""
        seg = self.manifest["next"]
        self._write(docs, seg)
        self.manifest |= {"postings": [*self.manifest["postings"], seg], "next": seg + 1}
        self._publish()

    def drop(self, ids: DataFrame) -> None:
        """De-index all rows of these ids."""
        seg = self.manifest["next"]
        ids.select(F.col("id").cast("long").alias("id")).distinct().write.parquet(f"{self.folder}/drops/seg={seg}")
        self.manifest |= {"drops": [*self.manifest["drops"], seg], "next": seg + 1}
        self._publish()

    def refresh(self, docs: DataFrame) -> dict[str, int]:
        """Make the index that of docs: only rows of ids whose texts are new, changed or gone are touched. Numbers of such ids."""
        now = docs.select(F.col("id").cast("long").alias("id"), F.coalesce(F.col("content").cast("string"), F.lit("")).alias("content"))
        mark = lambda df, a, b, name: df.groupBy(F.col("id").alias(f"{name}_id")).agg(F.struct(F.count("*"), *(F.sum(c.cast("decimal(38,0)")) for c in (a, b))).alias(name))
        old = mark(self.docs(), F.col("h"), F.col("g"), "old")
        new = mark(now, *_digests(F.col("content")), "new")
        both = new.join(old, F.col("new_id").eqNullSafe(F.col("old_id")), "full")
        kind = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").when(F.col("old") != F.col("new"), "changed")
        seg = self.manifest["next"]
        touched = f"{self.folder}/touched/seg={seg}"
        both.select(F.when(F.col("new").isNull(), F.col("old_id")).otherwise(F.col("new_id")).alias("id"), kind.alias("kind")).where("kind is not null").write.parquet(touched)
        found = self.spark.read.schema("id long, kind string").parquet(touched)
        counts = {r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()}  # three rows
        if counts:
            found.where("kind <> 'new'").select("id").write.parquet(f"{self.folder}/drops/seg={seg}")
            come = found.where("kind <> 'gone'").select(F.col("id").alias("_id"))
            self._write(now.join(come, F.col("id").eqNullSafe(F.col("_id")), "left_semi"), seg)
            self.manifest |= {"drops": [*self.manifest["drops"], seg], "postings": [*self.manifest["postings"], seg], "next": seg + 1}
            self._publish()
        return counts

    def compact(self) -> None:
        """One segment of all live rows; the old ones are read no more."""
        seg = self.manifest["next"]
        self.docs().drop("seg").write.parquet(f"{self.folder}/docs/seg={seg}")
        posts = self._live(self._scan("postings", _POSTINGS)).select("term", "id", "tf", "dl", "bucket")
        posts.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.folder}/postings/seg={seg}")
        self._publish(postings=[seg], drops=[], next=seg + 1, n=self.manifest["n"], total=self.manifest["total"])

    # --- reads

    def _scan(self, name: str, schema: str) -> DataFrame:
        segments = self.manifest["drops" if name == "drops" else "postings"]
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(*(f"{self.folder}/{name}/seg={k}" for k in segments))

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows whose id was not dropped in a later segment."""
        if not self.manifest["drops"]:
            return rows
        gone = self._scan("drops", _DROPS).groupBy(F.col("id").alias("_id")).agg(F.max("seg").alias("_gone"))
        return rows.join(gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("seg") < F.col("_gone")), "left_anti")

    def docs(self) -> DataFrame:
        """(id, dl, h, g, seg) of every live row."""
        return self._live(self._scan("docs", _DOCS))

    def lookup(self, queries: DataFrame) -> Built:
        """The live postings of the terms of queries(qid, text), from their buckets only, and the statistics of the whole index."""
        terms = query_terms(queries).select("term").distinct()
        buckets = [r[0] for r in terms.select(self._bucket(F.col("term"))).distinct().collect()]  # at most as many as the index has
        posts = self._scan("postings", _POSTINGS).where(F.col("bucket").isin(buckets))
        few = [r[0] for r in terms.limit(LISTED + 1).collect()]
        posts = posts.where(F.col("term").isin(few)) if len(few) <= LISTED else posts.join(terms, "term", "left_semi")
        n, total = self.manifest["n"], self.manifest["total"]
        stats = self.spark.createDataFrame([(n, total / n if n else None)], "n long, avgdl double")
        return Built(self._live(posts).select("id", "dl", "term", "tf"), stats)


_kept: dict[tuple[str, str], tuple[list, TextIndex]] = {}


def kept(spark: SparkSession, name: str, sources: list[str], docs) -> TextIndex:
    """The index that this session keeps under a name, made of docs() on first use and refreshed from it when the files it stands
    on, ``sources``, have other paths, sizes or times than then."""
    key, now = (spark.sparkContext.applicationId, name), _fingerprint(spark, sources)
    known = _kept.get(key)
    if known is not None and known[1]._newest() is not None:
        if known[0] != now:
            known[1].refresh(docs())
            _kept[key] = (now, known[1])
        return known[1]
    index = TextIndex.create(spark, docs())
    _kept[key] = (now, index)
    return index


def _fingerprint(spark: SparkSession, sources: list[str]) -> list:
    found = []
    for source in sources:
        path = spark._jvm.org.apache.hadoop.fs.Path(source)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


def _digests(content) -> tuple[F.Column, F.Column]:
    return F.xxhash64(content), F.xxhash64(F.lit("g"), content)
