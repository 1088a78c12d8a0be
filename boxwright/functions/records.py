"""Nested trajectories: an event's detections as one array of points (t, frame, bbox, conf), in order, and folds over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")


def with_trajectories(detections: DataFrame, keys: list[str], name: str = "trajectory") -> DataFrame:
    """keys and the trajectory of each: times in milliseconds' precision, boxes in tenths, confidence in four places."""
    point = F.struct(F.round("t", 3).alias("t"), "frame", F.array(*[F.round(c, 1) for c in BOX]).alias("bbox"), F.round("conf", 4).alias("conf"))
    rows = F.array_sort(F.collect_list(F.struct("frame", "event_id", point.alias("p"))))
    return detections.groupBy(*keys).agg(F.transform(rows, lambda x: x["p"]).alias(name))


def concatenated(parts: DataFrame, keys: list[str], order: list[str], name: str = "trajectory") -> DataFrame:
    """The trajectories of rows with equal keys, one after the other in order. A part without one (null) adds nothing."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.coalesce(name, F.array()).alias("_p"))))
    return parts.groupBy(*keys).agg(F.flatten(F.transform(ordered, lambda x: x["_p"])).alias(name))


def first_point(trajectory: Column) -> Column:
    """Null for an empty trajectory, as the other folds."""
    return F.get(trajectory, F.lit(0))


def last_point(trajectory: Column) -> Column:
    return F.try_element_at(trajectory, F.lit(-1))


def peak_point(trajectory: Column) -> Column:
    """The point of the highest confidence, the first of equal ones."""
    return F.aggregate(F.slice(trajectory, 2, F.greatest(F.size(trajectory), F.lit(1))), first_point(trajectory), lambda best, p: F.when(p["conf"] > best["conf"], p).otherwise(best))


def largest_gap(trajectory: Column) -> Column:
    """The longest time between two points that follow each other; null with fewer than two."""
    later = F.slice(trajectory, 2, F.greatest(F.size(trajectory), F.lit(1)))
    return F.array_max(F.transform(later, lambda p, i: F.round(p["t"] - F.get(trajectory, i)["t"], 3)))
