"""Which events a person must look at, and accessors of events whose names differ by their source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of the main review (fixed values).
EDGE_SECONDS, LOW_PEAK, LOW_EDGE_PEAK = 2.0, 0.70, 0.60
#: Hints that always need an explicit decision (fixed values).
ASK = ("cross_presence_span", "low_conf_review_candidate")


def main_review(tier: Column, peak: Column, seconds: Column, hints: Column) -> Column:
    """struct(keep, reason): edge candidates by their length, low confidence by its peak, everything else stays."""
    verdict = lambda keep, reason: F.struct(F.lit(keep).alias("keep"), F.lit(reason).alias("reason"))
    peak, seconds, hints = F.coalesce(peak, F.lit(0.0)), F.coalesce(seconds, F.lit(0.0)), F.coalesce(hints, F.array().cast("array<string>"))
    low = F.coalesce(tier == "low_conf", F.lit(False))
    partial = F.array_contains(hints, "edge_partial_face_candidate")
    return (
        F.when(partial & (seconds >= EDGE_SECONDS), verdict(True, "edge_partial_long")).when(partial, verdict(False, "edge_partial_short_aggressive_fallback"))
        .when(low & (peak >= LOW_PEAK), verdict(True, "low_conf_high_peak")).when(low & F.array_contains(hints, "edge_clip") & (peak >= LOW_EDGE_PEAK), verdict(True, "low_conf_edge_clip"))
        .when(low, verdict(False, "low_conf_below_main_review_threshold")).otherwise(verdict(True, "ordinary_review"))
    )


def explicit_accept(hints: Column, trajectory: Column, width: Column, height: Column, render: bool = False) -> Column:
    """Whether an event counts only once it is accepted: by its hints, a point of low confidence, or a large box at an edge.

    The render's rule (render) has a larger area, and takes wide boxes at the top too. Boxes of unknown frames (no width
    or height) and points without four numbers don't count; without a trajectory only hints do.
    """
    w, h = F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0))

    def at_edge(p):
        x1, y1, x2, y2 = (F.get(p["bbox"], i) for i in range(4))
        bw, bh = F.greatest(F.lit(0.0), x2 - x1), F.greatest(F.lit(0.0), y2 - y1)
        touches = (x1 <= 2) | (y1 <= 12) | (x2 >= w - 2) | (y2 >= h - 2)
        large = touches & (bw * bh / F.greatest(F.lit(1), w * h) > (0.035 if render else 0.03))
        if render:
            large = large | ((y1 <= 12) & (bw >= 180) & (bw / F.greatest(F.lit(1.0), bh) >= 1.35))
        return F.coalesce((F.size(p["bbox"]) == 4) & large, F.lit(False))

    points = F.coalesce(trajectory, F.array())
    hinted = F.arrays_overlap(F.coalesce(hints, F.array().cast("array<string>")), F.array(*[F.lit(x) for x in ASK]))
    faint = F.exists(points, lambda p: F.coalesce(p["conf"], F.lit(1.0)) < 0.55)
    return F.coalesce(hinted, F.lit(False)) | faint | ((w > 0) & (h > 0) & F.exists(points, at_edge))


def event_start(e: str = "") -> Column:
    """start_time, else start, else 0."""
    return F.coalesce(F.col(f"{e}start_time"), F.col(f"{e}start"), F.lit(0.0))


def event_end(e: str = "") -> Column:
    return F.coalesce(F.col(f"{e}end_time"), F.col(f"{e}end"), F.lit(0.0))


def event_seconds(e: str = "") -> Column:
    """From start to end, never below 0."""
    return F.greatest(F.lit(0.0), event_end(e) - event_start(e))
