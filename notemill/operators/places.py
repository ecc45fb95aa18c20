"""Places of rows in the order of their group, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def placed(rows: DataFrame, group: str, order: list[Column], name: str = "pos") -> DataFrame:
    """rows with their place (from 1) in their group. Rows are dealt to ranges of (group, order) and sorted there; a range's places start where
    the counts of the ranges before it end. A group may be of any size, as it lies in many ranges; equal rows stand one after another.
    The sorted rows are written to the shared folder when this is called, since ranges drawn twice need not be the same."""
    from ..sources.index import scratch

    sorted_rows = scratch(rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order).withColumn("_at", F.monotonically_increasing_id()))
    at = sorted_rows.withColumn("_range", F.shiftright("_at", 33))
    counts = at.groupBy("_range", group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))  # a row for each range and group in it
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_range", F.col(group).alias("_group"), "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    joined = at.join(starts, (at["_range"] == starts["_range"]) & at[group].eqNullSafe(starts["_group"]))
    return joined.select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias(name))
