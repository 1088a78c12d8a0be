"""Box expressions over columns (x1, y1, x2, y2), inside whole-stage code generation; *_sql give the oracle's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "") -> dict[str, Column]:
    return {k: F.col(prefix + k) for k in ("x1", "y1", "x2", "y2")}


def area(b: dict) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def iou(a: dict, b: dict) -> Column:
    """Intersection over union, 0 without a union."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def center_distance(a: dict, b: dict) -> Column:
    return F.sqrt(F.pow((a["x1"] + a["x2"] - b["x1"] - b["x2"]) / 2, F.lit(2)) + F.pow((a["y1"] + a["y2"] - b["y1"] - b["y2"]) / 2, F.lit(2)))


def center_ratio(a: dict, b: dict) -> Column:
    """Distance of centers over the largest side of either box, at least 1."""
    side = F.greatest(F.lit(1.0), *[x[k2] - x[k1] for x in (a, b) for k1, k2 in (("x1", "x2"), ("y1", "y2"))])
    return center_distance(a, b) / side


def diagonal(b: dict) -> Column:
    return F.sqrt(F.pow(b["x2"] - b["x1"], F.lit(2)) + F.pow(b["y2"] - b["y1"], F.lit(2)))


def center_continuous(a: dict, b: dict) -> Column:
    ref = F.greatest(diagonal(a), diagonal(b))
    return (ref > 0) & (center_distance(a, b) <= 1.5 * ref)


def area_ratio(a: dict, b: dict) -> Column:
    x, y = F.greatest(F.lit(1.0), area(a)), F.greatest(F.lit(1.0), area(b))
    return F.greatest(x, y) / F.least(x, y)


def relaxed_iou(conf_a: Column, conf_b: Column, base: float = 0.2) -> Column:
    """The IoU that is asked of a pair: less for confident pairs, 0.05 at least."""
    return F.greatest(F.lit(0.05), base - 0.12 * F.greatest(F.lit(0.0), (conf_a + conf_b) / 2 - 0.5))


def continuous(a: dict, b: dict, conf_a: Column, conf_b: Column) -> Column:
    return (iou(a, b) >= relaxed_iou(conf_a, conf_b)) | center_continuous(a, b)


def iou_sql(a: str, b: str) -> str:
    w = f"greatest(0.0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1))"
    h = f"greatest(0.0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1))"
    union = f"(({a}x2-{a}x1)*({a}y2-{a}y1) + ({b}x2-{b}x1)*({b}y2-{b}y1) - {w}*{h})"
    return f"(CASE WHEN {union} > 0 THEN {w}*{h}/{union} ELSE 0.0 END)"


def distance_sql(a: str, b: str) -> str:
    return f"sqrt(pow(({a}x1+{a}x2-{b}x1-{b}x2)/2, 2) + pow(({a}y1+{a}y2-{b}y1-{b}y2)/2, 2))"


def center_ratio_sql(a: str, b: str) -> str:
    sides = ", ".join(f"{x}x2-{x}x1, {x}y2-{x}y1" for x in (a, b))
    return f"({distance_sql(a, b)} / greatest(1.0, {sides}))"


def continuous_sql(a: str, b: str) -> str:
    ref = "greatest(" + ", ".join(f"sqrt(pow({x}x2-{x}x1, 2) + pow({x}y2-{x}y1, 2))" for x in (a, b)) + ")"
    need = f"greatest(0.05, 0.2 - 0.12 * greatest(0.0, ({a}conf + {b}conf) / 2 - 0.5))"
    return f"({iou_sql(a, b)} >= {need} OR ({ref} > 0 AND {distance_sql(a, b)} <= 1.5 * {ref}))"


def area_ratio_sql(a: str, b: str) -> str:
    x, y = (f"greatest(1.0, ({c}x2-{c}x1)*({c}y2-{c}y1))" for c in (a, b))
    return f"(greatest({x}, {y}) / least({x}, {y}))"
