"""Streaming twins: session taint floors and the forgetting fold."""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lifecycle import PARAMS, START_FLOOR, WEEK
from ..shared import shared_path


def floor_stream(events: DataFrame) -> DataFrame:
    """(session_id, floor): a running minimum is order-free, so a plain streaming aggregate keeps it."""
    taint = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "signup", 1)
    return events.groupBy(F.col("user_id").alias("session_id")).agg(F.least(F.lit(START_FLOOR), F.coalesce(F.min(taint), F.lit(START_FLOOR))).alias("floor"))


def file_stream(spark: SparkSession, folder: str, files: str, schema: T.StructType, at_once: int | None = None) -> DataFrame:
    """New Parquet files of a folder as they come; the stream's checkpoint is the cursor."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    return (reader.option("maxFilesPerTrigger", str(at_once)) if at_once else reader).parquet(folder)


def run(stream: DataFrame, mode: str, state: str | None = None) -> DataFrame:
    """Run a stream over what is there now and return what it gave: the last batch in complete mode, else all batches. Each batch
    has a path of its own, so a repeated one is harmless. With ``state`` a later run goes on from the cursor it keeps there."""
    spark = stream.sparkSession
    out = shared_path(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number:09d}")

    started = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state or f"{out}-state").trigger(availableNow=True).start()
    started.awaitTermination()
    if not started.recentProgress:
        return spark.createDataFrame([], stream.schema)
    found = spark.read.parquet(out)
    return (found.where(F.col("batch") == found.agg(F.max("batch")).first()[0]) if mode == "complete" else found).select(*stream.columns)


def run_available(spark: SparkSession, folder: str, files: str, schema: T.StructType) -> DataFrame:
    """Session floors over what is there now."""
    return run(floor_stream(file_stream(spark, folder, files, schema)), "complete")


def session_windows(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(user_id, started, ended, n) of a table or a stream, where ``late`` is the watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events
    found = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def daily_growth(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events a day, with late ones up to the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "n")


STATE = "rs double, ss double, t double, cnt long"


def _fold(first_seen: float):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        """Uses of one stem, in order within a trigger: decay to the time of the use, then reinforce."""
        p = PARAMS
        rs, ss, t, n = state.get if state.exists else (p["rs_seed"], p["ss_floor"], first_seen, 0)
        for when in sorted(float(x) for b in batches for x in b["t"]):
            if when > t:
                rs *= p["decay_base"] ** ((when - t) / WEEK / (1 + p["ss_decay_k"] * ss))
            ss = max(0.0, min(p["ss_cap"], ss + p["ss_gain"] * (1 - rs / p["rs_cap"])))
            rs, t, n = min(p["rs_cap"], rs + p["rs_gain"] * (1 + math.log1p(ss))), max(when, t), n + 1
        state.update((rs, ss, t, n))
        yield pd.DataFrame({"stem": [key[0]], "rs": [rs], "ss": [ss], "cnt": [n]})

    return run


def forget_stream(events: DataFrame, first_seen: str) -> DataFrame:
    """(stem, rs, ss, cnt) after each trigger, at the time of the last use, of a stream events(stem, ts). The batch operator's fold."""
    begun = datetime.fromisoformat(first_seen).replace(tzinfo=UTC).timestamp()
    rows = events.select("stem", F.unix_timestamp("ts").cast("double").alias("t"))
    return rows.groupBy("stem").applyInPandasWithState(_fold(begun), "stem long, rs double, ss double, cnt long", STATE, "update", "NoTimeout")
