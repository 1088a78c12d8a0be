"""What a mosaic covers: boxes padded by a share, rounded to pixels, and the size that their region shrinks to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shares that a region shrinks to, by level (fixed values).
LEVELS = {"low": 0.3, "medium": 0.15, "high": 0.08, "extreme": 0.03}
PAD = 0.2


def padded(b: dict, width: int, height: int, share: float = PAD) -> dict:
    """The box grown by a share of its size at each side, within the frame's last pixels."""
    w, h = (b["x2"] - b["x1"]) * share, (b["y2"] - b["y1"]) * share
    lo, hi = (lambda v: F.greatest(F.lit(0.0), v)), (lambda v, m: F.least(F.lit(float(m - 1)), v))
    return {"x1": lo(b["x1"] - w), "y1": lo(b["y1"] - h), "x2": hi(b["x2"] + w, width), "y2": hi(b["y2"] + h, height)}


def in_pixels(b: dict, width: int, height: int) -> dict:
    """The box in whole pixels of the frame, halves to the even one; without an extent it gets a pixel where there is room."""
    near = lambda v, m: F.greatest(F.lit(0), F.least(F.lit(m - 1), F.rint(v).cast("int")))
    x1, y1, x2, y2 = near(b["x1"], width), near(b["y1"], height), near(b["x2"], width), near(b["y2"], height)
    return {"x1": x1, "y1": y1, "x2": F.when(x2 <= x1, F.least(F.lit(width - 1), x1 + 1)).otherwise(x2), "y2": F.when(y2 <= y1, F.least(F.lit(height - 1), y1 + 1)).otherwise(y2)}


def mosaic_share(level: Column) -> Column:
    """The share of a level; a level that isn't known, or none, ends the job."""
    known = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    found = F.try_element_at(known, F.coalesce(level, F.lit("")))
    text = F.concat(F.lit("unknown mosaic level: "), F.coalesce(level, F.lit("none")), F.lit(f"; known: {', '.join(LEVELS)}"))
    return F.coalesce(found, F.raise_error(text).cast("double"))


def shrunk(side: Column, share: Column) -> Column:
    """Pixels that a side keeps: one at least, none of a region without extent."""
    share = F.greatest(F.lit(0.01), F.least(F.lit(1.0), share))
    return F.when(side >= 1, F.greatest(F.lit(1), F.rint(side * share).cast("int"))).otherwise(0)
