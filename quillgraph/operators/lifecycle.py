"""Session floors, policy, forgetting, verification age, merge and budget operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import RANK
from .scan import running_sums

START_FLOOR = 2
#: Forgetting model (fixed values).
PARAMS = {"rs_cap": 1.0, "rs_seed": 1.0, "decay_base": 0.5, "rs_gain": 0.15, "demote_below": 0.2, "grace_days": 21, "promote_at": 0.5, "ss_floor": 0.0, "ss_cap": 3.0, "ss_gain": 0.1, "ss_decay_k": 1.0, "ss_mig_k": 0.5}
WEEK = 7 * 86400.0


def rank_of(channel: Column) -> Column:
    out = F.lit(0)
    for name, rank in RANK.items():
        out = F.when(channel == name, F.lit(rank)).otherwise(out)
    return out


def guard(label: Column, ref: Column, ceiling: int, reserved: tuple[str, ...]) -> Column:
    return F.when(label > ceiling, "refused: above ceiling").when(ref.isin(*reserved), "refused: reserved name").otherwise("accepted")


def floors(calls: DataFrame, start: int = START_FLOOR) -> DataFrame:
    """calls(session_id, ts, event_id, taint) with the floor before and after each: a running minimum that never rises."""
    w = Window.partitionBy("session_id").orderBy("ts", "event_id")
    low = lambda frame: F.least(F.lit(start), F.coalesce(F.min("taint").over(frame), F.lit(start)))
    return calls.withColumn("floor", low(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", low(w.rowsBetween(Window.unboundedPreceding, -1)))


def glob_pattern(glob: str) -> str:
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def required_floor(tool: Column, rules: tuple[tuple[str, int], ...], default: int = 3) -> Column:
    """Of ordered (glob, required) rules the first that matches."""
    out = F.lit(default)
    for glob, required in reversed(rules):
        out = F.when(tool.rlike(glob_pattern(glob)), F.lit(required)).otherwise(out)
    return out


def forget(events: DataFrame, first_seen: str = "2024-01-01", now: str = "2024-02-05", p: dict | None = None) -> DataFrame:
    """(stem, cnt, rs, ss) of events(stem, ts, event_id): retrieval strength decays, more slowly with storage strength, and
    each use reinforces both. The fold over one stem's events in order is one expression over its sorted list."""
    p = PARAMS | (p or {})
    seconds = lambda c: F.unix_timestamp(c).cast("double")
    end = seconds(F.lit(now).cast("timestamp"))
    listed = events.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("ev"))
    times = F.transform("ev", lambda e: F.least(seconds(e["ts"]), end))
    decay = lambda rs, ss, dt: rs * F.pow(F.lit(p["decay_base"]), F.greatest(dt, F.lit(0.0)) / WEEK / (1.0 + p["ss_decay_k"] * ss))

    def step(state: Column, t: Column) -> Column:
        faded = decay(state["rs"], state["ss"], t - state["t"])
        ss = F.greatest(F.lit(0.0), F.least(F.lit(p["ss_cap"]), state["ss"] + p["ss_gain"] * (1.0 - faded / p["rs_cap"])))
        rs = F.least(F.lit(p["rs_cap"]), faded + p["rs_gain"] * (1.0 + F.log1p(ss)))
        return F.struct(rs.alias("rs"), ss.alias("ss"), t.alias("t"))

    start = F.struct(F.lit(p["rs_seed"]).alias("rs"), F.lit(p["ss_floor"]).alias("ss"), seconds(F.lit(first_seen).cast("timestamp")).alias("t"))
    folded = listed.select("stem", F.size("ev").cast("long").alias("cnt"), F.aggregate(times, start, step).alias("f"))
    return folded.select("stem", "cnt", F.round(decay(F.col("f.rs"), F.col("f.ss"), end - F.col("f.t")), 4).alias("rs"), F.round("f.ss", 4).alias("ss"))


def seed_strengths(p: dict) -> tuple[Column, Column]:
    """(rs, ss) that a memory starts a pass with: its own, else those of an older weight and count, else a new memory's, whose
    salience lifts its storage strength. Columns rs, ss, weight, count, salience, each may be null."""
    cap = F.lit(float(p["ss_cap"]))
    salience = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("salience", F.lit(0.0))))
    older = p["ss_floor"] + p["ss_mig_k"] * F.log1p(F.greatest(F.coalesce("count", F.lit(0)), F.lit(0)).cast("double"))
    rs = F.coalesce("rs", "weight", F.lit(float(p["rs_seed"])))
    ss = F.when(F.col("rs").isNotNull(), F.coalesce("ss", F.lit(float(p["ss_floor"])))).when(F.col("weight").isNotNull(), older).otherwise(p["ss_floor"] + (p["ss_cap"] - p["ss_floor"]) * salience)
    return F.least(rs, F.lit(float(p["rs_cap"]))), F.greatest(F.lit(0.0), F.least(ss, cap))


def forget_pass(mems: DataFrame, events: DataFrame, now: str, p: dict | None = None) -> DataFrame:
    """(stem, count, rs, ss, tier, action) of mems(stem, tier, pinned, stashed, is_stale, rs, ss, weight, count, salience, first_seen,
    last_used) after events(stem, ts, hits): decay to each use, one reinforcement for each hit, decay to now; uses of stale
    memories do not count.

    Pinned memories are hot. Hot ones turn cold below ``demote_below`` once they are ``grace_days`` old; cold ones whose index line
    is stashed turn hot again at ``promote_at``. Between the two thresholds nothing changes."""
    p = PARAMS | (p or {})
    seconds = lambda c: F.unix_timestamp(c).cast("double")
    end = seconds(F.lit(now).cast("timestamp"))
    listed = events.where("hits > 0").groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("ts", F.col("hits").cast("int").alias("hits")))).alias("ev"))
    rs0, ss0 = seed_strengths(p)
    rows = mems.join(listed, "stem", "left").withColumn("ev", F.when(~F.col("is_stale"), F.col("ev")))
    rows = rows.withColumn("ev", F.coalesce("ev", F.array().cast("array<struct<ts:timestamp,hits:int>>")))
    times = F.flatten(F.transform("ev", lambda e: F.array_repeat(F.least(F.coalesce(seconds(e["ts"]), end), end), e["hits"])))
    decay = lambda rs, ss, dt: rs * F.pow(F.lit(p["decay_base"]), F.greatest(dt, F.lit(0.0)) / WEEK / (1.0 + p["ss_decay_k"] * ss))

    def step(state: Column, t: Column) -> Column:
        faded = decay(state["rs"], state["ss"], t - state["t"])
        ss = F.greatest(F.lit(0.0), F.least(F.lit(p["ss_cap"]), state["ss"] + p["ss_gain"] * (1.0 - faded / p["rs_cap"])))
        return F.struct(F.least(F.lit(p["rs_cap"]), faded + p["rs_gain"] * (1.0 + F.log1p(ss))).alias("rs"), ss.alias("ss"), t.alias("t"))

    start = F.struct(rs0.alias("rs"), ss0.alias("ss"), F.coalesce(seconds(F.col("last_used")), seconds(F.col("first_seen")), end).alias("t"))
    done = rows.withColumn("f", F.aggregate(times, start, step)).withColumn("hits", F.aggregate("ev", F.lit(0).cast("long"), lambda n, e: n + e["hits"]))
    done = done.select("stem", "tier", "pinned", "stashed", (F.coalesce("count", F.lit(0)) + F.col("hits")).cast("long").alias("count"), F.round(decay(F.col("f.rs"), F.col("f.ss"), end - F.col("f.t")), 4).alias("rs"), F.round("f.ss", 4).alias("ss"), F.floor((end - F.coalesce(seconds(F.col("first_seen")), end)) / 86400).alias("age"))
    cold = (F.col("tier") == "hot") & (F.col("rs") < p["demote_below"]) & (F.col("age") >= p["grace_days"])
    back = (F.col("tier") == "cold") & F.col("stashed") & (F.col("rs") >= p["promote_at"])
    target = F.when(F.col("pinned"), "hot").when(cold, "cold").when(back, "hot").otherwise(F.col("tier"))
    action = F.when(target != F.col("tier"), F.concat(F.col("tier"), F.lit(" to "), target))
    return done.select("stem", "count", "rs", "ss", target.alias("tier"), action.alias("action"))


# Phrases that say that work is not finished, and the form of a due date.
UNFINISHED = "deployed|applied|migrated|pushed|merged|installed|built|rebuilt|configured|fixed|wired|implemented|shipped|done|complete|completed|finished|live"
UNDONE = "deployed|pushed|merged|migrated|applied|finished|shipped"
_UNSETTLED = rf"(?i)\bnot\s+(?:\w+\s+)?(?:{UNFINISHED})\b|\bun(?:{UNDONE})\b"
_DUE = r"(?i)\b(?:due|deadline)\b[:\s]+(\d{4}-\d{2}-\d{2})"


def verify_stale(notes: DataFrame, now: str, threshold_days: int) -> DataFrame:
    """(id, reason) of notes(id, content, seen): a passed due date, or a state that nobody has verified for too long."""
    today = F.lit(now).cast("date")
    dates = F.filter(F.transform(F.regexp_extract_all("content", F.lit(_DUE), F.lit(1)), lambda d: F.try_to_date(d)), lambda d: d <= today)
    due = F.array_min(dates)
    old = F.col("content").rlike(_UNSETTLED) & (F.datediff(today, F.col("seen")) > threshold_days)
    reason = F.when(due.isNotNull(), F.concat(F.lit("overdue: "), due.cast("string"), F.lit(" passed"))).when(old, F.concat(F.lit("unverified since "), F.date_format("seen", "yyyy-MM")))
    return notes.select("id", reason.alias("reason")).where("reason is not null")


def merge(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, action, label, tombstoned, redacted): incoming(id, label, tombstoned, redacted, trusted) into local, monotonically."""
    l, i = local.alias("l"), incoming.alias("i")
    new, known = F.col("l.id").isNull(), F.col("i.id").isNotNull()
    flag = lambda c: F.when(new, F.col(f"i.{c}")).when(F.col("i.trusted"), F.greatest(f"l.{c}", f"i.{c}")).otherwise(F.col(f"l.{c}"))
    rises = F.col("i.trusted") & ((F.col("i.tombstoned") > F.col("l.tombstoned")) | (F.col("i.redacted") > F.col("l.redacted")))
    action = F.when(new & F.col("i.trusted"), "inserted").when(new, "inserted, clamped").when(~known, "kept").when(rises, "updated").otherwise("unchanged")
    label = F.when(new & ~F.col("i.trusted"), F.lit(0)).otherwise(F.coalesce("l.label", "i.label"))
    return l.join(i, F.col("l.id") == F.col("i.id"), "full_outer").select(F.coalesce("l.id", "i.id").alias("id"), action.alias("action"), label.alias("label"), flag("tombstoned").alias("tombstoned"), flag("redacted").alias("redacted"))


def shed(rows: DataFrame, section: str, order: tuple[str, ...], budget: int) -> DataFrame:
    """rows(..., bytes) with kept: entries of a section in order while their running sum fits."""
    return running_sums(rows, [section], list(order), ["bytes"]).withColumn("kept", F.col("bytes_sum") <= budget).drop("bytes_sum")


def upsert(base: DataFrame, new: DataFrame, key: str, replace: bool = True) -> DataFrame:
    """base with the rows of new by key: known keys are replaced, or kept where ``replace`` is not set. Of several new rows with one
    key the greatest counts, so the result does not depend on their order."""
    others = [c for c in base.columns if c != key]
    one = new.groupBy(key).agg(F.max(F.struct(*others)).alias("_n")).select(key, F.col("_n"))
    old = base.select(key, F.struct(*others).alias("_o"))
    row = F.coalesce("_n", "_o") if replace else F.coalesce("_o", "_n")
    return old.join(one, key, "full_outer").select(key, row.alias("_r")).select(key, "_r.*").select(*base.columns)


def sections(lines: DataFrame) -> DataFrame:
    """lines(doc, pos, line) with the section, the last heading ``## ...`` at or above the line; null before the first."""
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.when(F.startswith("line", F.lit("## ")), F.substr("line", F.lit(4)))
    return lines.withColumn("section", F.last(heading, ignorenulls=True).over(w))


def index_stats(lines: DataFrame, budget: int, section_budget: int) -> DataFrame:
    """(doc, n_lines, bytes, n_sections, over_budget, over) of index notes lines(doc, pos, line)."""
    by = sections(lines).groupBy("doc", "section").agg(F.count("*").alias("n"), F.sum(F.octet_length("line") + 1).alias("b"))
    above = F.col("section").isNotNull() & (F.col("b") > section_budget)
    return by.groupBy("doc").agg(F.sum("n").alias("n_lines"), F.sum("b").alias("bytes"), F.count("section").alias("n_sections"), F.sum(above.cast("long")).alias("over_budget"), (F.sum("b") > budget).alias("over"))
