"""Scalar rules: tiers, hints, quality classes, timecodes, rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tier(peak: Column) -> Column:
    return F.when(peak >= 0.85, "auto").when(peak >= 0.75, "review").otherwise("low_conf")


def timecode(seconds: Column) -> Column:
    """HH:MM:SS.mmm, truncated."""
    ms = F.floor(seconds * 1000)
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def quality_class(n: Column, duration: Column, max_gap: Column, interpolation: Column) -> Column:
    low = ((n <= 2) & (duration >= 3)) | ((n <= 3) & (duration >= 8)) | (max_gap >= 10) | (interpolation >= 0.9)
    medium = ((n <= 4) & (duration >= 5)) | (max_gap >= 5) | (interpolation >= 0.7)
    return F.when(low, "LOW").when(medium, "MEDIUM").otherwise("HIGH")


def falsy(value: Column, default) -> Column:
    """Zero and null count as missing."""
    return F.coalesce(F.nullif(value, F.lit(0)), F.lit(default))


def safe_stem(name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), F.lit("")), F.lit("video"))


def frame_rate(text: Column) -> Column:
    """'30000/1001' or '25' as a number."""
    parts = F.split(text, "/")
    return F.try_divide(parts[0].cast("double"), F.coalesce(F.try_element_at(parts, F.lit(2)).cast("double"), F.lit(1.0)))


def temporal_score(gap: Column, tau: float) -> Column:
    return F.when(gap < 0, 0.0).otherwise(F.exp(-gap / max(tau, 1.0)))


def bhattacharyya(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.sqrt(F.greatest(F.lit(0.0), x.cast("double") * y))), F.lit(0.0), lambda s, v: s + v)
    return F.least(F.lit(1.0), total)


def bhattacharyya_roots(a: Column, b: Column) -> Column:
    """The same over the roots of both histograms, taken before the join."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return F.least(F.lit(1.0), total)


def cosine(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def ema(values: Column, alpha: float) -> Column:
    """Recursive blend over an ordered array of numbers."""
    step = lambda s, v: F.concat(s, F.array(F.when(F.size(s) == 0, v).otherwise(alpha * v + (1 - alpha) * F.coalesce(F.try_element_at(s, F.lit(-1)), v))))
    return F.aggregate(values, F.array().cast("array<double>"), step)


def even_sample(values: Column, k: int) -> Column:
    """k elements at even distances, first and last included, each once."""
    n = F.size(values)
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * (n - 1) / max(k - 1, 1)).cast("int") + 1)
    return F.when(n <= k, values).otherwise(F.transform(F.array_distinct(at), lambda i: F.element_at(values, i)))
