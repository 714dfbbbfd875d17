"""Shared folders and lineage cuts.

Everything a later stage reads again is written below the folder that the cluster names in
``spark.checkpoint.dir``: all executors and the driver see it, so a lost executor costs a retry, not the data.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_batches(spark: SparkSession, most: int = 4_000_000) -> None:
    """Arrow batches of at most ``most`` bytes in all later plans of the session, unless it has a value of its own: whole texts
    come 10,000 at a time otherwise, which executors hold twice for each task beside their heap."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b") in ("67108864b", "67108864", "64m"):
        spark.conf.set(key, str(most))


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode, where the session names none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _session_paths(spark).append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a scan of it: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote for ``df``, once nothing that is still to be computed reads it: a loop's state of the round
    before."""
    path = getattr(df, "_written_at", None)
    if path is not None:
        _delete(df.sparkSession, path)


def discard_all(spark: SparkSession) -> None:
    """Delete all that this session has written to the shared folder. Results not yet computed are lost with it."""
    for path in _session_paths(spark):
        _delete(spark, path)
    _session_paths(spark).clear()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_paths: dict[str, list[str]] = {}


def _session_paths(spark: SparkSession) -> list[str]:
    return _paths.setdefault(spark.sparkContext.applicationId, [])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
