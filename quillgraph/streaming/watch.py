"""Watching files: a stream of file events that settles before it acts, with event-time timers.

A file's events wait in its state until nothing has come for ``gap`` seconds of event time (the watermark tells); then its last event
counts, once. What is known of the file says what that means: a first content is a create, another content an update, the same
content nothing, a removal of a known file a prune. ``settled`` is the same over a table.

Defined results: events without a path or time are ignored; events of one time go by their number; an event that is not
after the watermark is dropped by Spark; events that have not settled when the stream ends stay in the state for the next run.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.window import Window

ACTIONS = "path string, at timestamp, action string, hash string"


@contextmanager
def state_store(spark: SparkSession):
    """The state store that transformWithState needs, as the session's for a while."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Settle(StatefulProcessor):
    """State of a file: its known content, and the events that have not settled."""

    def __init__(self, gap_seconds: int):
        self.gap = gap_seconds * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "hash string")
        self.waiting = handle.getValueState("waiting", "events string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = self._waiting()
        for part in rows:
            events += part[["ms", "n", "hash"]].astype({"hash": object}).where(part[["ms", "n", "hash"]].notna(), None).values.tolist()
        yield from self._act(key[0], events, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._act(key[0], self._waiting(), timerValues)

    def _waiting(self) -> list:
        return json.loads(self.waiting.get()[0]) if self.waiting.exists() else []

    def _act(self, path: str, events: list, timers) -> Iterator[pd.DataFrame]:
        mark, before = timers.getCurrentWatermarkInMs(), self.known.get()[0] if self.known.exists() else None
        known, out = before, []
        events = sorted([int(ms), int(n), h] for ms, n, h in events)
        while events:
            # the first burst: events that follow each other within the gap
            last = 0
            while last + 1 < len(events) and events[last + 1][0] - events[last][0] <= self.gap:
                last += 1
            at, _, h = events[last]
            if at + self.gap >= mark:
                self.handle.registerTimer(at + self.gap)
                break
            if h != known:
                out.append((path, pd.Timestamp(at, unit="ms"), "prune" if h is None else "update" if known is not None else "create", h))
                known = h
            events = events[last + 1 :]
        if events:
            self.waiting.update((json.dumps(events),))
        else:
            self.waiting.clear()
        if known != before:
            self.known.update((known,)) if known is not None else self.known.clear()
        if out:
            yield pd.DataFrame(out, columns=["path", "at", "action", "hash"])

    def close(self) -> None:
        pass


def _events(events: DataFrame) -> DataFrame:
    good = events.where(F.col("path").isNotNull() & F.col("ts").isNotNull())
    return good.select("path", F.col("ts").cast("timestamp").alias("ts"), F.col("n").cast("long").alias("n"), "hash")


def watch(events: DataFrame, gap_seconds: int, late: str) -> DataFrame:
    """(path, at, action, hash) of a stream events(path, ts, n, hash), where a null hash is a removal. Start it within
    ``state_store``."""
    rows = _events(events).withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return rows.groupBy("path").transformWithStateInPandas(Settle(gap_seconds), ACTIONS, "append", "EventTime")


def settled(events: DataFrame, gap_seconds: int, mark) -> DataFrame:
    """(path, at, action, hash) of a table events(path, ts, n, hash) as a stream with the watermark ``mark`` (a column of one
    value) has given them."""
    w = Window.partitionBy("path").orderBy("ms", "n")
    ms = F.unix_millis("ts")
    rows = _events(events).withColumn("ms", ms).withColumn("follows", F.lead("ms").over(w))
    # the last of a burst, if the burst has settled; bursts before one that has not settled have
    ends = rows.where((F.col("follows").isNull() | (F.col("follows") - F.col("ms") > gap_seconds * 1000)) & (F.col("ms") + gap_seconds * 1000 < F.unix_millis(mark)))
    ends = ends.withColumn("known", F.lag("hash").over(w))
    action = F.when(F.col("hash").isNull(), "prune").when(F.col("known").isNull(), "create").otherwise("update")
    return ends.where(~F.col("hash").eqNullSafe(F.col("known"))).select("path", F.timestamp_millis("ms").alias("at"), action.alias("action"), "hash")


PINS = "tool string, n long, pinned string, seen string, hits long"


class Pin(StatefulProcessor):
    """First-seen pins and counters: the first hash of a tool is pinned, each call is counted, another hash is reported."""

    def init(self, handle) -> None:
        self.pin = handle.getValueState("pin", "hash string, hits long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows)).sort_values(["ts", "n"], kind="stable")
        pinned, hits = self.pin.get() if self.pin.exists() else (calls["hash"].iloc[0], 0)
        calls = calls.assign(hits=range(hits + 1, hits + 1 + len(calls)))
        self.pin.update((pinned, hits + len(calls)))
        bad = calls[calls["hash"] != pinned]
        if len(bad):
            yield pd.DataFrame({"tool": key[0], "n": bad["n"], "pinned": pinned, "seen": bad["hash"], "hits": bad["hits"]})

    def close(self) -> None:
        pass


def pin_calls(calls: DataFrame) -> DataFrame:
    """(tool, n, pinned, seen, hits) of each call in a stream calls(tool, ts, n, hash) whose hash is not the tool's first. Within a
    batch calls go by (ts, n). A batch's calls of one tool are in memory at once."""
    good = calls.where("tool is not null and hash is not null").select("tool", F.col("ts").cast("timestamp").alias("ts"), F.col("n").cast("long").alias("n"), "hash")
    return good.groupBy("tool").transformWithStateInPandas(Pin(), PINS, "append", "None")
