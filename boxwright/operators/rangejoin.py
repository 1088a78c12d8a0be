"""Range and as-of joins by buckets and ordered unions: no nested loops.

range_join explodes each left window into the buckets that it touches and joins on the bucket, so a pair meets
exactly once (in the bucket of the right row's point).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_join(left: DataFrame, right: DataFrame, lo: Column, hi: Column, point: str, width: float, on: list[str] | None = None) -> DataFrame:
    """Rows of left and right with lo <= point <= hi (and equal columns `on`); width is about hi - lo."""
    on = on or []
    a = left.withColumn("_lo", lo).withColumn("_hi", hi).filter("_hi >= _lo")
    a = a.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))))
    b = right.withColumn("_b", F.floor(F.col(point) / width))
    return a.join(b, [*on, "_b"]).filter(F.col(point).between(F.col("_lo"), F.col("_hi"))).drop("_b", "_lo", "_hi")


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, point: str, value: str, forward: bool = False) -> DataFrame:
    """left with value: of right's rows, the last at or before (forward: the first at or after) left's `at`."""
    a = left.withColumn("_at", F.col(at)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(0 if forward else 1))
    b = right.select(*keys, F.col(point).alias("_at"), F.col(value).alias("_v"), F.lit(1 if forward else 0).alias("_side"))
    # forward runs from the end: a frame up to the last row would start anew at each row
    order, side = ((F.desc("_at"), F.desc("_side")), 0) if forward else ((F.asc("_at"), F.asc("_side")), 1)
    found = F.last("_v", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(value, found).filter(F.col("_side") == side).select(*left.columns, value)
