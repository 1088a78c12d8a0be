"""Run parameters: what a mode presets, what a run asks for instead, and the least values allowed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("legacy", "preview", "production", "fast_review", "privacy")
#: What each mode presets, in the order of MODES (fixed values).
PRESETS = {
    "interval": (5, 5, 2, 3, 1),
    "conf": (0.35, 0.25, 0.25, 0.23, 0.20),
    "imgsz": (1280, 960, 1280, 1280, 1536),
    "expand": (0.18, 0.28, 0.25, 0.26, 0.35),
    "mosaic_block": (22, 18, 22, 22, 18),
    "render_extend_frames": (3, 10, 12, 14, 18),
    "mask_review": (False, True, True, True, True),
    "motion_compensate": (False, True, True, True, True),
    "motion_max_gap": (45, 60, 45, 60, 45),
    "motion_singleton_frames": (12, 30, 30, 36, 45),
    "edge_partial_face": (False, True, True, True, True),
    "edge_review_scan": (False, True, True, False, True),
    "low_conf_standalone": (True, True, True, False, True),
    "fast_identity": (False, False, False, True, False),
}
#: Parameters without a preset: default and least value (fixed values).
LIMITS = {"detect_batch": (1, 1), "mask_scale_divisor": (8, 4), "filter_threads": (1, 1)}


def resolve(mode: Column, asked: dict[str, Column]) -> dict[str, Column]:
    """A column for each parameter: what was asked for, or else the preset of the mode (an unknown mode fails).

    A review of masks can be switched on, not off. Numbers with a limit take 0 as not asked for.
    """
    known = F.when(mode.isin(*MODES), mode).otherwise(F.raise_error(F.concat(F.lit("unknown mode: "), mode)))
    out = {}
    for name, values in PRESETS.items():
        preset = F.element_at(F.create_map(*[F.lit(x) for pair in zip(MODES, values, strict=True) for x in pair]), known)
        if name == "mask_review":
            out[name] = F.coalesce(asked.get(name, F.lit(False)), F.lit(False)) | preset
        else:
            out[name] = F.coalesce(asked[name], preset) if name in asked else preset
    for name, (default, least) in LIMITS.items():
        value = F.coalesce(F.nullif(asked[name], F.lit(0)), F.lit(default)) if name in asked else F.lit(default)
        out[name] = F.greatest(F.lit(least), value)
    return out
