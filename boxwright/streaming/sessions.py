"""Streaming extensions: the segmentation rules on an unbounded stream of detections (no counterpart in batch ids)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def presence_sessions(stream: DataFrame, time: str = "ts", gap: str = "3 seconds", late: str = "10 seconds") -> DataFrame:
    """Presence segments as session windows: rows up to `gap` apart are one segment; later rows than `late` are dropped."""
    return (
        stream.withWatermark(time, late)
        .groupBy("track_id", F.session_window(time, gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("detection_count"), F.max("conf").alias("peak_confidence"))
        .select("track_id", F.col("w.start").alias("start_time"), F.col("w.end").alias("closes_at"), "detection_count", "peak_confidence")
    )


def stride_counts(stream: DataFrame, time: str = "ts", width: str = "5 seconds", late: str = "10 seconds") -> DataFrame:
    """Tumbling counts of detections and tracks."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w")).agg(F.count(F.lit(1)).alias("detections"), F.approx_count_distinct("track_id").alias("tracks")).select(F.col("w.start").alias("start_time"), "detections", "tracks")
