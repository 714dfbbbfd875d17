"""Valid-time sale enrichment: a streaming query with one transformWithState stage, keyed by the client's hash.

The stage takes the sales and the changes of a batch. Sales wait in its state until the watermark H passes their sold_at; the versions
are added, the sales below H are answered from them, and then of a client's versions up to H only the last stays.

A key is one of ``slots`` ranges of the hash, so a task holds the versions of many clients as sorted arrays and answers all its
sales of a batch in array operations. Clients with more than one in ``SPREAD`` sales (fewer than ``SPREAD`` of them) have slots of
their own, as many as their share asks for; their sales are dealt over these by hash, their versions go to each. Slots and hot
clients are fixed for the life of a checkpoint. What waits, or may be pruned, sets a timer of the next batch, so slots without new
rows release and prune, too.

Every start loads a state store for each partition of each stage with state, and RocksDB does not give back all memory of a store
that is unloaded, so sales that wait have no stage of their own.

The query is started anew for each batch on one checkpoint, with the batch's watermarks as parameters: they are the maxima of
earlier batches, one row a batch. A batch is fed by moving its files into the folder that the query reads; batches without rows get
an empty file. Each start writes its own folder again if it is repeated, so a lost executor or driver costs a retry.

Defined results: sales with a null sold_at pass at once and find no version; sales and changes with a null client meet nothing
(n_held 0; such a change can still be late); changes with a null valid_at are ignored; a null seq or change_id is the least; equal
rows of changes count once, equal rows of sales each; a null arrived_at goes to the last batch, days before the first to batch 0;
null or NaN balances give null; empty tables give what the other gives; extra columns are ignored but for telling changes apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..shared import shared_path

BATCHES, FIRST_DAY, DAYS, DELAY_HOURS = 10, 19723, 152, 36
#: A client with more than one in SPREAD sales is spread over slots of about that size; the most and the least sales of a slot, on average.
SPREAD, SLOT_ROWS, LEAST_ROWS = 64, 20_000, 2_000
#: Changes that one task writes, where there are more than its cores' share.
WRITE_ROWS = 200_000
_LEAST = -(1 << 63)
_OUT = "rec string, id long, batch long, n_held long, change_id long, balance_cents long, op string"
#: Times are microseconds; absent values travel as 0 beside a false flag, so that no integer becomes a float on its way.
_SALES = "slot int, client long, has_client boolean, id long, has_id boolean, t long, has_t boolean"
_CHANGES = "client long, has_client boolean, id long, has_id boolean, t long, seq long, has_seq boolean, cents long, op string"


def micros(c) -> F.Column:
    """Microseconds since 1970 of a timestamp as it reads, with or without a zone."""
    second = (F.hour(c) * 3600 + F.minute(c) * 60).cast("long") * 1_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return day(c).cast("long") * 86_400_000_000 + second


def day(c) -> F.Column:
    return F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))


def batch_of(days, batches: int = BATCHES) -> F.Column:
    """least() passes over nulls: rows without a day are in the last batch."""
    number = F.floor((days - FIRST_DAY) * batches / DAYS).cast("int")
    return F.least(F.lit(batches - 1), F.when(number < 0, 0).otherwise(number)).cast("int")


def _flagged(c: str, name: str) -> list[F.Column]:
    return [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(name), F.col(c).isNotNull().alias(f"has_{name}")]


def _pack(frame: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all().to_pandas()


class Slot(StatefulProcessor):
    """Sales that wait and versions of the clients of a slot: adds the new ones, answers the sales below ``h`` and those without a time,
    then prunes the versions up to ``h``. State is one row of two packed tables, and a timer of the next batch where it has to be
    looked at again."""

    SALE = ["client", "has_client", "id", "has_id", "t", "has_t"]
    COLUMNS = ["client", "t", "seq", "has_seq", "id", "has_id", "cents", "op"]
    ORDER = ["client", "t", "has_seq", "seq", "has_id", "id"]

    def __init__(self, h: int, batch: int):
        self.h, self.batch = h, batch

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("rows", "waiting binary, versions binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = [None if data is None else _unpack(bytes(data)) for data in self.state.get() or (None, None)]
        sales, held = ([] if table is None else [table] for table in before)
        for part in rows:
            sale = part["sale"].to_numpy(dtype=bool)
            if sale.any():
                sales.append(part.loc[sale, self.SALE])
            if not sale.all():
                held.append(part.loc[~sale, self.COLUMNS].astype({"cents": "Int64"}))
        waiting, versions = before
        if len(held) > (versions is not None):
            versions = pd.concat(held, ignore_index=True).sort_values(self.ORDER, ignore_index=True, kind="stable")
        if sales:
            sales = pd.concat(sales, ignore_index=True)
            now = (~sales["has_t"] | (sales["t"] < self.h)).to_numpy(dtype=bool)
            if now.any():
                yield self._answer(sales[now].reset_index(drop=True), versions)
            waiting = None if now.all() else sales[~now].reset_index(drop=True)
        again = waiting is not None
        if versions is not None:
            client, t = versions["client"].to_numpy(), versions["t"].to_numpy()
            # the next version of the client is not above h either
            old = np.r_[(client[1:] == client[:-1]) & (t[1:] <= self.h), False]
            versions = versions[~old].reset_index(drop=True)
            client = client[~old]
            again |= bool((client[1:] == client[:-1]).any())
        self._keep(before, [waiting, versions])
        if again:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1)

    def _keep(self, before: list, after: list) -> None:
        if all(a is b or (a is not None and b is not None and a.equals(b)) for a, b in zip(after, before)):
            return
        if all(table is None for table in after):
            self.state.clear()
        else:
            self.state.update(tuple(None if table is None else _pack(table) for table in after))

    def _answer(self, sales: pd.DataFrame, versions: pd.DataFrame | None) -> pd.DataFrame:
        n = len(sales)
        out = pd.DataFrame({"rec": "sale", "id": sales["id"].where(sales["has_id"]).astype("Int64"), "batch": self.batch, "n_held": 0}).reset_index(drop=True)
        if versions is None:
            return out.assign(change_id=pd.array([None] * n, "Int64"), balance_cents=pd.array([None] * n, "Int64"), op=None)
        c, t = sales["client"].to_numpy(), sales["t"].to_numpy()
        has = sales["has_client"].to_numpy(dtype=bool)
        vc, vt = versions["client"].to_numpy(), versions["t"].to_numpy()
        low = np.searchsorted(vc, c)
        out["n_held"] = np.where(has, np.searchsorted(vc, c, side="right") - low, 0)
        # sales fall in line behind the versions of their time: how many versions come before each?
        order = np.lexsort((np.r_[np.zeros(len(vc), bool), np.ones(n, bool)], np.r_[vt, t], np.r_[vc, c]))
        before = np.empty(len(order), dtype=np.int64)
        before[order] = np.cumsum(order < len(vc))
        at = before[len(vc) :] - 1
        found = has & sales["has_t"].to_numpy(dtype=bool) & (at >= low)
        row = versions.iloc[np.where(found, at, 0)].reset_index(drop=True)
        out["change_id"] = row["id"].where(found & row["has_id"].to_numpy(dtype=bool)).astype("Int64")
        out["balance_cents"] = row["cents"].astype("Int64").where(pd.Series(found))
        out["op"] = row["op"].where(found, None)
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.handleInputRows(key, iter(()), timerValues)


def watermarks(sales: DataFrame, changes: DataFrame, batches: int = BATCHES, delay_hours: int = DELAY_HOURS) -> list[tuple[int, int]]:
    """For each batch the watermarks of both tables, from their (batch, t): one row a batch reaches the driver."""
    both = sales.select(F.lit(0).alias("side"), "batch", F.when(F.col("has_t"), F.col("t")).alias("t")).unionByName(changes.select(F.lit(1).alias("side"), "batch", "t"))
    top = {(r["side"], r["batch"]): r["top"] for r in both.groupBy("side", "batch").agg(F.max("t").alias("top")).where("top is not null").collect()}
    marks, seen = [], [_LEAST, _LEAST]
    for b in range(batches):
        marks.append(tuple(s if s == _LEAST else s - delay_hours * 3_600_000_000 for s in seen))
        seen = [max(s, top.get((k, b), _LEAST)) for k, s in enumerate(seen)]
    return marks


def _move(spark: SparkSession, source: str, target: str) -> bool:
    """Move a folder of the shared file system, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(source)):
        return False
    fs.mkdirs(path(target).getParent())
    if not fs.rename(path(source), path(target)):
        raise OSError(f"{source} could not be moved to {target}")
    return True


def enriched(sales: DataFrame, changes: DataFrame, h: int, late: int, batch: int, slots: int, hot: list[tuple[int, int, int]]) -> DataFrame:
    """The plan of one start: what batch ``batch`` of the streams gives out. ``hot``: (client, first slot, number of slots)."""
    absent = lambda columns: [F.lit(None).cast(kind).alias(c) for c, kind in (x.split() for x in columns.split(", "))]
    waiting = sales.select("slot", F.lit(True).alias("sale"), *Slot.SALE, F.lit(0).cast("long").alias("seq"), F.lit(False).alias("has_seq"), *absent("cents long, op string"))
    on_time = changes.where((F.col("t") >= late) & F.col("has_client"))
    place = F.array(_slot(F.col("client"), slots))
    for client, first, n in hot:
        place = F.when(F.col("client") == client, F.sequence(F.lit(first), F.lit(first + n - 1))).otherwise(place)
    versions = on_time.select(F.explode(place).alias("slot"), F.lit(False).alias("sale"), "client", "has_client", "id", "has_id", "t", F.lit(True).alias("has_t"), "seq", "has_seq", "cents", "op")
    answers = waiting.unionByName(versions).groupBy("slot").transformWithStateInPandas(Slot(h, batch), _OUT, "append", "ProcessingTime")
    too_late = changes.where(F.col("t") < late).select(F.lit("late").alias("rec"), F.when(F.col("has_id"), F.col("id")).alias("id"), F.lit(batch).cast("long").alias("batch"), *absent(_OUT.split(", ", 3)[3]))
    return answers.unionByName(too_late)


def _slot(c, slots: int) -> F.Column:
    return F.pmod(F.xxhash64(c), F.lit(slots)).cast("int")


def slots_for(sales: int, partitions: int) -> int:
    """Four slots a partition, so that partitions are even, but none of few sales: each visit of a slot has a price of its own."""
    return max(sales // SLOT_ROWS, min(4 * partitions, sales // LEAST_ROWS), 1)


def _hot_clients(sales: DataFrame, slots: int) -> list[tuple[int, int, int]]:
    """(client, first slot, number of slots) of the fewer than SPREAD clients with more than one in SPREAD sales."""
    total = sales.count()
    counts = sales.where("client_id is not null").groupBy("client_id").count().where(F.col("count") > total / SPREAD).orderBy("client_id").collect()
    hot, first = [], slots
    for r in counts:
        n = -(-r["count"] * SPREAD // total)
        hot.append((r["client_id"], first, n))
        first += n
    return hot


_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # each start loads its state anew, so nothing has to stay open on the executors' disks after a commit
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    # one cache for all stores of an executor, not one for each
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # would write a second file for each file of the checkpoint
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
}


def enrich_batches(sales: DataFrame, changes: DataFrame, batches: int = BATCHES, delay_hours: int = DELAY_HOURS, slots: int | None = None) -> DataFrame:
    """Cut sales and changes into batches and feed them to the streaming query; (rec, id, batch, n_held, change_id, balance_cents,
    op) of all batches."""
    spark = sales.sparkSession
    root = shared_path(spark, "op13")
    sales = sales.select(F.col("sale_id").cast("long").alias("sale_id"), F.col("client_id").cast("long").alias("client_id"), "sold_at", "arrived_at")
    if slots is None:
        slots = slots_for(sales.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = _hot_clients(sales, slots)
    # a sale without a client goes by its own hash, one of a hot client by its hash over that client's slots
    own = F.xxhash64(F.lit("client's slot"), "sale_id", "sold_at")
    slot = F.when(F.col("client_id").isNull(), F.pmod(own, F.lit(slots))).otherwise(_slot(F.col("client_id"), slots))
    for client, first, n in hot:
        slot = F.when(F.col("client_id") == client, F.lit(first) + F.pmod(own, F.lit(n))).otherwise(slot)
    staged = sales.select(
        batch_of(day("arrived_at"), batches).alias("batch"), slot.cast("int").alias("slot"),
        *_flagged("client_id", "client"), *_flagged("sale_id", "id"), F.coalesce(micros("sold_at"), F.lit(0)).alias("t"), F.col("sold_at").isNotNull().alias("has_t"),
    )
    staged.write.partitionBy("batch").parquet(f"{root}/staged/sales")
    shift = F.crc32(F.col("change_id").cast("string").cast("binary")) % 4
    cents = F.when(~F.isnan("balance"), F.floor(100 * F.col("balance").cast("double") + 0.5).cast("long"))
    # each task writes a file for each batch, so tasks go by rows and cores, not by the partitions of distinct()
    writers = max(spark.sparkContext.defaultParallelism, changes.count() // WRITE_ROWS)
    changes.where("valid_at is not null").distinct().coalesce(writers).select(
        batch_of(day("valid_at") + shift, batches).alias("batch"), *_flagged("client_id", "client"), *_flagged("change_id", "id"), micros("valid_at").alias("t"),
        *_flagged("seq", "seq"), cents.alias("cents"), F.col("op").cast("string").alias("op"),
    ).write.partitionBy("batch").parquet(f"{root}/staged/changes")
    shapes = {"sales": _SALES, "changes": _CHANGES}
    read = [spark.read.schema(f"{shape}, batch int").parquet(f"{root}/staged/{name}") for name, shape in shapes.items()]
    marks = watermarks(*read, batches, delay_hours)
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    try:
        for k, v in _SETTINGS.items():
            spark.conf.set(k, v)
        for b in range(batches + 1):
            for name, shape in shapes.items():
                if not _move(spark, f"{root}/staged/{name}/batch={b}", f"{root}/fed/{name}/{b:06d}"):
                    spark.createDataFrame([], shape).coalesce(1).write.parquet(f"{root}/fed/{name}/{b:06d}")
            streams = [spark.readStream.schema(shape).option("recursiveFileLookup", "true").parquet(f"{root}/fed/{name}") for name, shape in shapes.items()]
            # after the last batch all that waits passes
            last = b == batches
            plan = enriched(*streams, h=(1 << 63) - 1 if last else min(marks[b]), late=_LEAST if last else marks[b][1], batch=b, slots=slots, hot=hot)
            _start(plan, f"{root}/out/{b:06d}", f"{root}/checkpoint")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(_OUT).parquet(*(f"{root}/out/{b:06d}" for b in range(batches + 1)))


def _start(plan: DataFrame, out: str, checkpoint: str) -> None:
    """One start of the query on its checkpoint, for what is there now."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(out)

    query = plan.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def op13_sale_versions(spark, sf_dir):
    return enrich_batches(spark.read.parquet(f"{sf_dir}/sales.parquet"), spark.read.parquet(f"{sf_dir}/client_changes.parquet"))


#: crc32 of the decimal text, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(change_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b:
  list_reduce(list_prepend(xor(a, b), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295::BIGINT)"""


def _sql() -> str:
    """A sale's batch is the first whose H is above it; a version is gone in batch e if a later one was below H in batch e - 1."""
    number = f"floor((date_diff('day', DATE '1970-01-01', {{day}}::DATE) {{shift}} - {FIRST_DAY}) * {BATCHES} / {DAYS})::INT"
    cut = lambda day, shift="": f"least({BATCHES - 1}, CASE WHEN {number.format(day=day, shift=shift)} < 0 THEN 0 ELSE {number.format(day=day, shift=shift)} END)"
    return f"""
WITH s AS MATERIALIZED (SELECT row_number() OVER () AS r, sale_id, client_id, sold_at, {cut("arrived_at")} AS b FROM sales),
v AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY valid_at, seq NULLS FIRST, change_id NULLS FIRST) AS n, {cut("valid_at", f"+ {_CRC} % 4")} AS b
  FROM (SELECT DISTINCT * FROM client_changes WHERE valid_at IS NOT NULL)),
top AS (SELECT k AS b, (SELECT max(sold_at) FROM s WHERE s.b < k) - INTERVAL {DELAY_HOURS} HOUR AS ws, (SELECT max(valid_at) FROM v WHERE v.b < k) - INTERVAL {DELAY_HOURS} HOUR AS wc
  FROM range(0, {BATCHES}) t(k)),
m AS MATERIALIZED (SELECT b, wc, CASE WHEN ws IS NOT NULL AND wc IS NOT NULL THEN least(ws, wc) END AS h FROM top),
kept AS MATERIALIZED (SELECT v.* FROM v JOIN m USING (b) WHERE m.wc IS NULL OR v.valid_at >= m.wc),
out AS MATERIALIZED (SELECT s.r, s.sale_id, s.client_id, s.sold_at, CASE WHEN s.sold_at IS NULL THEN s.b ELSE coalesce(min(m.b), {BATCHES}) END AS e
  FROM s LEFT JOIN m ON m.b >= s.b AND s.sold_at < m.h GROUP BY s.r, s.sale_id, s.client_id, s.sold_at, s.b),
last AS (SELECT kept.client_id, m.b + 1 AS e, max(n) AS n FROM kept JOIN m ON kept.b <= m.b AND kept.valid_at <= m.h GROUP BY 1, 2),
held AS MATERIALIZED (SELECT kept.*, t.e FROM kept JOIN (SELECT DISTINCT client_id, e FROM out) t ON kept.client_id = t.client_id AND kept.b <= t.e
  LEFT JOIN last ON last.client_id = t.client_id AND last.e = t.e WHERE kept.b = t.e OR last.n IS NULL OR kept.n >= last.n),
size AS (SELECT client_id, e, count(*) AS n_held FROM held GROUP BY 1, 2),
best AS (SELECT out.r, arg_max(held.n, held.n) AS n FROM out JOIN held ON out.client_id = held.client_id AND out.e = held.e AND held.valid_at <= out.sold_at GROUP BY 1)
SELECT 'sale' AS rec, sale_id AS id, out.e::BIGINT AS batch, coalesce(n_held, 0)::BIGINT AS n_held, v.change_id, floor(100 * v.balance + 0.5)::BIGINT AS balance_cents, v.op
FROM out LEFT JOIN size ON out.client_id = size.client_id AND out.e = size.e LEFT JOIN best ON out.r = best.r LEFT JOIN v ON v.n = best.n
UNION ALL SELECT 'late', change_id, v.b::BIGINT, NULL, NULL, NULL, NULL FROM v JOIN m USING (b) WHERE v.valid_at < m.wc
"""


OP13_SQL = _sql()
