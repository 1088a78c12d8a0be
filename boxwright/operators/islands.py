"""Gaps and islands: split an ordered sequence wherever a rule on a row and its predecessor says so.

One shuffle by the keys; the running sum stays in the same partitioning as the lag.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut


def islands(df: DataFrame, keys: list[str], order: list[str], splits: Callable[[DataFrame], Column], carry: list[str], name: str = "seg") -> DataFrame:
    """df with name: the number (from 0) of each row's island within keys; carried columns come as prev_<column>."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df
    for c in carry:
        out = out.withColumn(f"prev_{c}", F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    out = out.withColumn("_new", F.when(first, 0).when(F.coalesce(splits(out), F.lit(False)), 1).otherwise(0))
    return out.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def runs(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Maximal runs of consecutive whole numbers: keys, start_frame, end_frame (both inclusive)."""
    w = Window.partitionBy(*keys).orderBy(value)
    d = df.select(*keys, value).distinct().withColumn("_g", F.col(value) - F.row_number().over(w))
    return d.groupBy(*keys, "_g").agg(F.min(value).alias("start_frame"), F.max(value).alias("end_frame")).drop("_g")


def coalesce_intervals(df: DataFrame, keys: list[str], start: str, end: str, gap: float = 0) -> DataFrame:
    """Merge intervals whose start is at most gap behind the largest end so far."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = df.withColumn("_new", F.when(F.col(start) - before <= gap, 0).otherwise(1))
    d = d.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def coalesce_spread(df: DataFrame, keys: list[str], start: str, end: str, gap: float, width: int) -> DataFrame:
    """As coalesce_intervals, for few keys with many intervals: sorted within buckets of width starts each.

    Of intervals with equal start only the longest counts. What reaches over a bucket's border, the largest end and
    the number of islands before it, comes from a running maximum and sum over one row for each bucket. Intervals and
    islands are written once, since each is read again.
    """
    d = cut(df.groupBy(*keys, start).agg(F.max(end).alias(end)).withColumn("_b", F.floor(F.col(start) / width)))
    inner, outer = Window.partitionBy(*keys, "_b").orderBy(start), Window.partitionBy(*keys).orderBy("_b")
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ends = d.groupBy(*keys, "_b").agg(F.max(end).alias("_m")).select(*keys, "_b", F.max("_m").over(so_far(outer)).alias("_ahead"))
    d = d.join(ends, [*keys, "_b"])
    before = F.greatest(F.max(end).over(so_far(inner)), F.col("_ahead"))  # greatest skips nulls
    d = cut(d.withColumn("_new", F.when(F.col(start) - before <= gap, 0).otherwise(1)))
    news = d.groupBy(*keys, "_b").agg(F.sum("_new").alias("_n")).select(*keys, "_b", F.coalesce(F.sum("_n").over(so_far(outer)), F.lit(0)).alias("_past"))
    d = d.join(news, [*keys, "_b"]).withColumn("_g", F.col("_past") + F.sum("_new").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def complement(df: DataFrame, keys: list[str], total: Column) -> DataFrame:
    """Tiles [0, total): the given inclusive, disjoint intervals as 'render', the holes as 'copy'."""
    w = Window.partitionBy(*keys).orderBy("start_frame")
    d = df.withColumn("_total", total)
    render = d.select(*keys, F.lit("render").alias("type"), "start_frame", "end_frame")
    ahead = d.select(*keys, F.lit("copy").alias("type"), F.coalesce(F.lag("end_frame").over(w) + 1, F.lit(0)).alias("start_frame"), (F.col("start_frame") - 1).alias("end_frame"))
    tail = d.groupBy(*keys).agg(F.max("end_frame").alias("e"), F.first("_total").alias("t")).select(*keys, F.lit("copy").alias("type"), (F.col("e") + 1).alias("start_frame"), (F.col("t") - 1).alias("end_frame"))
    return render.unionByName(ahead).unionByName(tail).filter("start_frame <= end_frame")
