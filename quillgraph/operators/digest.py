"""The digest of a store: entries under section headings that fit limits of bytes and of lines at once.

entries(id, section, kind, cluster, own_line, pinned, live_state, rs, born, line): ``line`` is the entry as it is written, ``kind``
literal or file. Sections shed first, down to a cap of their own, which pins do not escape; then the whole sheds. What is left out
has a reason: section_budget, budget (too many bytes when it went) or lines (bytes were fine, lines were not).

A shed is a running sum over the reverse of the order in which entries go, so it takes a prefix scan, whatever the number of entries. The
heading of a section and the blank line after it count with the entry that goes last, or for good where an entry is exempt.

Defined results: entries without a section are not in the digest (reason unsectioned); a null rs is 0; a null born is the oldest; null
flags are false; ties go by id, the smaller goes first; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialise
from .scan import running_sums

ENTRY = ("id", "section", "kind", "cluster", "own_line", "pinned", "live_state", "rs", "born", "line")


class DigestTooLarge(ValueError):
    """Entries that are never shed exceed a limit by themselves."""


def _bytes(c) -> F.Column:
    return (F.octet_length(c) + 1).cast("long")


def shed_sections(entries: DataFrame, caps: dict[str, int] | int) -> DataFrame:
    """entries with fits: false for those their section sheds under its cap (one for all, or by section; no cap, no shed). Newest
    go first, plain ones before those with a line of their own; literals and clusters stay."""
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    cap = F.lit(caps) if isinstance(caps, int) else F.coalesce(*(F.when(F.col("section") == s, n) for s, n in caps.items()), F.lit(None).cast("int"))
    rows = entries.withColumns({"_free": (F.col("kind") == "file") & ~flag("cluster"), "_b": _bytes("line"), "_cap": cap.cast("long"), "_own": ~flag("own_line"), "_rs": -F.coalesce("rs", F.lit(0.0)), "_id": -F.col("id")})
    rows = rows.withColumn("_first", F.col("_free").cast("int"))  # what stays comes first, so that its bytes are before all others
    summed = running_sums(rows, ["section"], ["_first", "_own", "born", "_rs", "_id"], ["_b"])
    over = _bytes(F.concat(F.lit("## "), "section")) + 1 + F.col("_b_sum") > F.col("_cap")
    return summed.select(*entries.columns, F.coalesce(~(F.col("_free") & over), F.lit(True)).alias("fits"))


def digest(entries: DataFrame, budget: int, max_lines: int, title: str = "# Memory", caps: dict[str, int] | int | None = None, strict: bool = True) -> DataFrame:
    """(id, kept, reason) of every entry. The weakest go first, live states last; pinned entries and literals stay. Where these alone
    exceed a limit, that is an error, or, if not ``strict``, all others go."""
    entries = materialise(entries.select(*ENTRY), "digest")
    named = entries.where("section is not null")
    named = materialise(shed_sections(named, caps) if caps else named.withColumn("fits", F.lit(True)), "digest")
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    rows = named.where("fits").withColumns({
        "_exempt": (F.col("kind") != "file") | flag("pinned"), "_b": _bytes("line"), "_live": ~flag("live_state"), "_rs": -F.coalesce("rs", F.lit(0.0)), "_id": -F.col("id"),
    })
    order = F.struct("_live", "_rs", "_id")
    # a section's heading and blank line go with its last entry in the order of leaving
    tops = rows.groupBy("section").agg(F.max("_exempt").alias("_held"), F.min_by("id", order).alias("_last"), F.sum(F.when(F.col("_exempt"), F.col("_b"))).alias("_b"), F.count_if("_exempt").alias("_n"))
    head = _bytes(F.concat(F.lit("## "), "section")) + 1
    fixed = tops.agg(F.coalesce(F.sum(F.coalesce("_b", F.lit(0)) + F.when(F.col("_held"), head).otherwise(0)), F.lit(0)).alias("b"), F.coalesce(F.sum(F.col("_n") + F.when(F.col("_held"), 2).otherwise(0)), F.lit(0)).alias("n")).first()
    # all lines and their ends, the last blank one without its end; lines are counted by ends
    b, n = fixed["b"] + len(title.encode()) + 1, fixed["n"] + 1
    if strict and (b > budget or n > max_lines):
        raise DigestTooLarge(f"pinned and literal entries take {b} bytes and {n} lines of {budget} and {max_lines}")
    free = rows.where("not _exempt").join(tops.where("not _held").select("section", "_last", head.alias("_head")), "section", "left")
    owns = F.coalesce(F.col("_last") == F.col("id"), F.lit(False))
    free = free.withColumns({"b": F.col("_b") + F.when(owns, F.col("_head")).otherwise(0), "n": F.when(owns, 3).otherwise(1).cast("long")})
    summed = running_sums(free.select("id", "_live", "_rs", "_id", "b", "n"), [], ["_live", "_rs", "_id"], ["b", "n"])
    reason = F.when(F.col("b_sum") + b > budget, "budget").when(F.col("n_sum") + n > max_lines, "lines")
    told = summed.select("id", reason.alias("reason"))
    none = F.lit(None).cast("string")
    for part, why in ((rows.where("_exempt"), none), (named.where("not fits"), F.lit("section_budget")), (entries.where("section is null"), F.lit("unsectioned"))):
        told = told.unionByName(part.select("id", why.alias("reason")))
    return told.select("id", F.col("reason").isNull().alias("kept"), "reason")


def render(entries: DataFrame, kept: DataFrame, title: str = "# Memory") -> DataFrame:
    """One row (text): the digest as it is written. What is kept fits the limits, so it is small."""
    lines = entries.join(kept.where("kept").select("id"), "id", "left_semi").groupBy("section").agg(F.array_sort(F.collect_list(F.struct((F.col("kind") != "literal").alias("f"), "id", "line"))).alias("e"))
    block = F.concat(F.lit("## "), "section", F.lit("\n"), F.array_join(F.transform("e", lambda x: x["line"]), "\n"), F.lit("\n"))
    blocks = lines.agg(F.array_sort(F.collect_list(F.struct("section", block.alias("b")))).alias("all"))
    return blocks.select(F.concat(F.lit(title + "\n"), F.array_join(F.transform("all", lambda x: F.concat(F.lit("\n"), x["b"])), "")).alias("text"))
