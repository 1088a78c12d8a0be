"""Rows numbered in one global order, and pages of them, without a sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut

_SHIFT = 33


def numbered(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """df with `number`, from 0 in the order of the columns of order, which must tell all rows apart.

    Ranges of the order are sorted side by side and written, as ranges are drawn from a sample and would differ when
    computed again; a row's place in its range and the rows of the ranges before it (one row a range) make its number.
    """
    spread = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    placed = cut(spread.sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", _SHIFT)
    placed = placed.withColumn("_part", part).withColumn("_place", F.col("_id").bitwiseAND(F.lit((1 << _SHIFT) - 1)))
    # one row a range: as many as the session has shuffle partitions at most
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return placed.join(F.broadcast(offsets), "_part").withColumn("number", F.col("_offset") + F.col("_place")).drop("_id", "_part", "_place", "_offset")


def page(rows: DataFrame, offset: int, limit: int | None = None) -> DataFrame:
    """Numbered rows from offset on, limit at most; an offset below 0 is 0, no limit or one of 0 takes all."""
    offset = max(0, offset)
    found = rows.filter(F.col("number") >= offset)
    return found.filter(F.col("number") < offset + limit) if limit and limit > 0 else found
