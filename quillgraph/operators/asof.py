"""As-of joins by row: each probe meets the last fact of its key that is not after the probe's own time.

Facts and probes are sorted together once, by ranges of (key, time), so a key with any share of the rows is split over ranges. Within
a range the last fact is carried on by a window over (range, key); into a range comes what the ranges before it end with for its
first key, one row for each range. Facts of one time go by further columns, and come before probes of that time.

Defined results: every probe row gives one row, with nulls where no fact fits; a null key or a null time of a probe meets nothing;
facts with a null key or time are ignored; with ``first`` a probe before all facts of its key takes the first; null values of the
further columns are the least; of facts that are equal in all of these any is taken; empty tables give what the other side gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import materialise


def asof_join(probes: DataFrame, facts: DataFrame, key: str, probe_time: str, fact_time: str, order: tuple[str, ...] = (), first: bool = False, name: str = "fact", ranges: int | None = None) -> DataFrame:
    """probes with a column ``name``: the struct of all columns of the fact, or null."""
    ranges = ranges or int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fact, row = F.struct(*facts.columns), F.struct(*probes.columns)
    none_fact, none_row = (F.lit(None).cast(df.select(s.alias("s")).schema[0].dataType) for df, s in ((facts, fact), (probes, row)))
    tie = F.struct(F.lit(0).alias("_"), *(F.col(c).alias(f"c{n}") for n, c in enumerate(order)))
    none_tie = F.lit(None).cast(facts.select(tie.alias("s")).schema[0].dataType)
    known = facts.where(F.col(key).isNotNull() & F.col(fact_time).isNotNull())
    left = known.select(F.col(key).alias("k"), F.col(fact_time).alias("t"), F.lit(0).alias("kind"), tie.alias("tie"), fact.alias("fact"), none_row.alias("row"))
    right = probes.where(F.col(key).isNotNull() & F.col(probe_time).isNotNull()).select(F.col(key).alias("k"), F.col(probe_time).alias("t"), F.lit(1).alias("kind"), none_tie.alias("tie"), none_fact.alias("fact"), row.alias("row"))
    # the rows of a range are written with its number: another sampling of the ranges cannot mix with this one
    spread = left.unionByName(right).repartitionByRange(ranges, "k", "t", "kind", "tie", F.xxhash64("row"))
    spread = materialise(spread.withColumn("range", F.spark_partition_id()), "asof")
    here = Window.partitionBy("range", "k").orderBy("t", "kind", "tie").rowsBetween(Window.unboundedPreceding, 0)
    found = spread.withColumn("found", F.last("fact", ignorenulls=True).over(here)).where("kind = 1").select("range", "k", "row", "found")
    # one row a range at most: the last key of the range that has a fact there, and where the key goes on
    ends = spread.groupBy("range").agg(F.max("k").alias("k"))
    tails = spread.where("kind = 0").join(F.broadcast(ends), ["range", "k"]).groupBy("range", "k").agg(F.max_by("fact", F.struct("t", "tie")).alias("tail"))
    starts = spread.groupBy("range").agg(F.min("k").alias("k")).select(F.col("range").alias("into"), "k")
    carried = starts.join(F.broadcast(tails), "k").where("range < into").groupBy(F.col("into").alias("range"), "k").agg(F.max_by("tail", "range").alias("carried"))
    out = found.join(F.broadcast(carried), ["range", "k"], "left").select("k", "row", F.coalesce("found", "carried").alias("found"))
    if first:
        lead = known.groupBy(F.col(key).alias("k")).agg(F.min_by(fact, F.struct(F.col(fact_time), tie)).alias("lead"))
        early = out.where("found is null").join(lead, "k", "left").select("row", F.col("lead").alias("found"))
        out = out.where("found is not null").select("row", "found").unionByName(early)
    out = out.select("row.*", F.col("found").alias(name))
    return out.unionByName(probes.where(F.col(key).isNull() | F.col(probe_time).isNull()).withColumn(name, none_fact))


#: Fixed value: a reference to a fact inside a text.
REFERENCE = r"\[\[(fact_[A-Za-z0-9_-]+)\]\]"
#: Fixed value: the reason that a sweep gives, which a retired fact does not repeat.
SWEPT = "source file removed (bridge reconcile)"


def resolve_references(texts: DataFrame, versions: DataFrame, pattern: str = REFERENCE) -> DataFrame:
    """(id, text) of texts(id, text, as_of), with each reference replaced by the fact's present value, and what it was when the
    text was written; of a retired fact by its last value and when it was retired. versions(stem, nid, value, unit, created_at,
    tombstoned, tombstoned_at, reason). References to unknown facts, or to facts without a value, stay as they are. A text
    without as_of shows present values only; null texts stay null; equal ids are separate rows."""
    parts = F.split("text", pattern, -1)
    rows = texts.withColumn("n", F.monotonically_increasing_id()).select("id", "text", "as_of", "n")
    rows = materialise(rows, "references")
    refs = rows.select("n", "as_of", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("pos", "stem"))
    shown = F.when(F.col("value").isNotNull(), F.concat_ws(" ", "value", F.when(F.col("unit") != "", F.col("unit"))))
    v = versions.select("stem", "nid", shown.alias("shown"), "created_at", "tombstoned", "tombstoned_at", F.trim("reason").alias("reason"))
    order = F.struct("created_at", "nid")
    alive = F.col("tombstoned") == 0
    now = v.groupBy("stem").agg(F.min_by(F.struct("nid", "shown"), F.when(alive, F.col("nid"))).alias("live"), F.max_by(F.struct("shown", "tombstoned_at", "reason"), order).alias("last"))
    met = asof_join(refs, v.select("stem", "nid", "shown", "created_at"), "stem", "as_of", "created_at", ("nid",), first=True, name="then").join(now, "stem", "left")
    when, why = F.date_format("last.tombstoned_at", "yyyy-MM-dd"), F.col("last.reason")
    retired = F.concat(F.col("last.shown"), F.lit(" (last known — fact retired"), F.when(when.isNotNull(), F.concat(F.lit(" "), when)).otherwise(""), F.when((why != "") & (why != SWEPT), F.concat(F.lit(": "), why)).otherwise(""), F.lit(")"))
    moved = (F.col("then.nid") != F.col("live.nid")) & (F.col("then.shown") != "") & (F.col("then.shown") != F.col("live.shown"))
    current = F.when(moved, F.concat("live.shown", F.lit(" (was "), "then.shown", F.lit(" when written, "), F.date_format("as_of", "yyyy-MM-dd"), F.lit(")"))).otherwise(F.col("live.shown"))
    value = F.when(F.col("live").isNotNull(), F.when(F.col("live.shown") != "", current)).when(F.col("last.shown") != "", retired)
    met = met.select("n", "pos", F.coalesce(value, F.concat(F.lit("[["), "stem", F.lit("]]"))).alias("value"))
    put = met.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("put"))
    out = rows.join(put, "n", "left")
    whole = F.array_join(F.transform(parts, lambda x, k: F.concat(x, F.coalesce(F.get(F.col("put"), k)["value"], F.lit("")))), "")
    return out.select("id", F.when(F.col("put").isNull(), F.col("text")).otherwise(whole).alias("text"))
