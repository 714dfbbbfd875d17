"""Audit of a folder of memory files against its index and the store: findings as rows (name, severity, target, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys that a file's front matter needs, types, reasons of the last render that explain a missing entry, links.
KEYS = ("name", "description", "type")
TYPES = ("user", "personal", "feedback", "project", "reference", "fact")
EXPLAINED = ("budget", "lines", "projects", "section_budget")
LINK = r"(?i)\[\[([a-z0-9][a-z0-9_-]*)\]\]"


def _bare(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def link_key(c: Column) -> Column:
    """File names and links spell the same name with ``_`` or ``-``, in either case."""
    return F.lower(F.translate(c, "_", "-"))


def audit(files: DataFrame, index: DataFrame, store: DataFrame | None, index_bytes: int | None = None, budget: int | None = None) -> DataFrame:
    """Findings of files(file, stem, name, description, type, section, in_index, reason, content) by index(file), the files that it links,
    and store(stem, tier) of live memories; None if the store cannot be read. reason is why the last render left a file out.

    Files without a link that are not cold: ``withdrawn`` or ``needs-cluster`` on purpose, nothing if the render explains it, else
    ``pending-import`` or ``orphan-file``. Links without a file, missing keys, unknown types, links in texts that lead nowhere (one row
    for each target, with the number of files that hold it), and an index beyond its budget."""
    row = lambda df, name, severity, target, detail=F.lit(None): df.select(F.lit(name).alias("name") if isinstance(name, str) else name.alias("name"), F.lit(severity).alias("severity") if isinstance(severity, str) else severity.alias("severity"), target.alias("target"), detail.cast("string").alias("detail"))
    linked = index.select("file").distinct()
    alone = files.select("file", "stem", "section", "in_index", "reason").join(linked, "file", "left_anti")
    if store is not None:
        alone = alone.join(store.groupBy("stem").agg(F.max((F.col("tier") == "cold").cast("int")).alias("cold")), "stem", "left").where("coalesce(cold, 0) = 0")
    withdrawn = F.coalesce(F.col("reason") == "unsectioned", F.lit(False)) | (_bare(F.col("section")) == "none") | _bare(F.col("in_index")).isin("false", "no", "0")
    held, explained = (F.coalesce(c, F.lit(False)) for c in (F.col("reason") == "needs_cluster", F.col("reason").isin(*EXPLAINED)))
    last = F.lit("orphan-file") if store is None else F.when(F.col("cold").isNull(), "pending-import").otherwise("orphan-file")
    kind = F.when(withdrawn, "withdrawn").when(held, "needs-cluster").when(~explained, last)
    severity = F.when(F.col("kind") != "orphan-file", "INFO").otherwise("WARN" if store is None else "ERROR")
    found = [row(alone.withColumn("kind", kind).where("kind is not null"), F.col("kind"), severity, F.col("file"))]
    found.append(row(linked.join(files.select("file"), "file", "left_anti"), "dead-index-link", "ERROR", F.col("file")))
    missing = F.filter(F.array(*(F.when(F.coalesce(F.col(k), F.lit("")) == "", F.lit(k)) for k in KEYS)), lambda k: k.isNotNull())
    found.append(row(files.where(F.size(missing) > 0), "frontmatter-missing", "ERROR", F.col("file"), F.array_join(missing, ", ")))
    found.append(row(files.where((F.coalesce("type", F.lit("")) != "") & ~F.col("type").isin(*TYPES)), "bad-type", "WARN", F.col("file"), F.col("type")))
    targets = files.select("file", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(LINK), F.lit(1)))).alias("target"))
    broken = targets.groupBy("target").agg(F.count("*").alias("n")).withColumn("k", link_key(F.col("target")))
    names = files.select(F.explode(F.array_compact(F.array(link_key(F.col("stem")), link_key(F.col("name"))))).alias("k")).distinct()
    found.append(row(broken.join(names, "k", "left_anti"), "broken-wikilink", "INFO", F.col("target"), F.col("n")))
    if index_bytes is not None and budget is not None and index_bytes > budget:
        found.append(row(files.sparkSession.range(1), "budget-breach", "WARN", F.lit("index"), F.lit(index_bytes - budget)))
    return reduce(DataFrame.unionByName, found)
