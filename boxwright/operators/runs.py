"""Run lengths: prefix sums over (count, value) runs and lookups in them, without a row for each element."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rangejoin

#: Runs that one window adds up, and elements that one lookup window spans.
BLOCK, SPAN = 4096, 65536


def prefixed(runs: DataFrame, keys: list[str], order: str, count: str, value: str, block: int = BLOCK) -> DataFrame:
    """runs with `first`, the elements before it, and `before`, the sum of count * value before it.

    Two levels: sums of blocks of consecutive runs by key, then within a block, so a key of many runs is many tasks;
    only a key's blocks meet in one window. order is a whole number, dense or not; runs without elements go.
    """
    d = runs.filter(F.col(count) > 0).withColumn("_n", F.col(count).cast("long")).withColumn("_s", F.col("_n") * F.col(value)).withColumn("_blk", F.floor(F.col(order) / block))
    up = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy(*keys, "_blk").agg(F.sum("_n").alias("_bn"), F.sum("_s").alias("_bs"))
    w = up(Window.partitionBy(*keys).orderBy("_blk"))
    sums = sums.select(*keys, "_blk", F.coalesce(F.sum("_bn").over(w), F.lit(0)).alias("_bn"), F.coalesce(F.sum("_bs").over(w), F.lit(0)).alias("_bs"))
    w = up(Window.partitionBy(*keys, "_blk").orderBy(order))
    d = d.join(sums, [*keys, "_blk"])
    first, before = F.col("_bn") + F.coalesce(F.sum("_n").over(w), F.lit(0)), F.col("_bs") + F.coalesce(F.sum("_s").over(w), F.lit(0))
    return d.withColumns({"first": first, "before": before}).drop("_n", "_s", "_blk", "_bn", "_bs")


def at_elements(elements: DataFrame, runs: DataFrame, keys: list[str], at: str, count: str, value: str, span: int = SPAN) -> DataFrame:
    """elements (keys, at: from 1) with `total`, the sum of all values before theirs; those outside the runs go.

    runs are prefixed. A run is put into each span that it touches, and elements look back within their span, so
    neither long runs nor keys of many elements are one task.
    """
    lo, hi = F.col("first"), F.col("first") + F.col(count) - 1
    r = runs.select(*keys, F.struct("first", "before", F.col(count).alias("n"), F.col(value).alias("v")).alias("_run"), F.col("first").alias("_at0"), F.explode(F.sequence(F.floor(lo / span), F.floor(hi / span))).alias("_span"))
    e = elements.withColumn("_pos", F.col(at) - 1).withColumn("_span", F.floor(F.col("_pos") / span)).filter("_pos >= 0")
    found = rangejoin.asof(e, r, [*keys, "_span"], "_pos", "_at0", "_run").filter(F.col("_pos") < F.col("_run.first") + F.col("_run.n"))
    return found.withColumn("total", F.col("_run.before") + (F.col("_pos") - F.col("_run.first")) * F.col("_run.v")).drop("_pos", "_span", "_run")
