"""Running sums over any number of rows: a prefix scan of two levels.

Rows are sorted by ranges of (key, order); each range sums for itself, the totals of the ranges give what comes before each, and
no window holds more than a range. A key with any share of the rows is split over ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import free_name, materialise


def running_sums(rows: DataFrame, key: list[str], order: list[str], values: list[str], ranges: int | None = None) -> DataFrame:
    """rows with ``<value>_sum`` for each of values: its sum over the rows of the key up to this one, in ascending order, nulls
    first. Rows that are equal in key and order must be told apart by the order's last column, or are summed in any order; null
    keys are one key, null values count as 0."""
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k, part = free_name(rows, "k"), free_name(rows, "range")
    spread = rows.withColumn(k, F.struct(F.lit(0).alias("_"), *(F.col(c).alias(f"c{n}") for n, c in enumerate(key))))
    spread = materialise(spread.repartitionByRange(ranges, k, *order).withColumn(part, F.spark_partition_id()), "scan")
    here = Window.partitionBy(part, k).orderBy(*(F.col(c).asc_nulls_first() for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    own = spread.select("*", *(F.coalesce(F.sum(v).over(here), F.lit(0)).alias(f"{v}_sum") for v in values))
    # one row a range at most: only the last key of a range goes on in later ranges, and only as their first key
    edges = spread.groupBy(part).agg(F.min(k).alias("_first"), F.max(k).alias("_last"))
    last = edges.select(part, F.col("_last").alias(k))
    tails = spread.join(F.broadcast(last), [part, k]).groupBy(part, k).agg(*(F.coalesce(F.sum(v), F.lit(0)).alias(f"_{n}") for n, v in enumerate(values)))
    first = edges.select(F.col(part).alias("_into"), F.col("_first").alias(k))
    before = first.join(F.broadcast(tails), k).where(F.col(part) < F.col("_into")).groupBy(F.col("_into").alias(part), k).agg(*(F.sum(f"_{n}").alias(f"_{n}") for n in range(len(values))))
    out = own.join(F.broadcast(before), [part, k], "left")
    return out.select(*rows.columns, *((F.col(f"{v}_sum") + F.coalesce(f"_{n}", F.lit(0))).alias(f"{v}_sum") for n, v in enumerate(values)))
