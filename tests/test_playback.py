"""The plain render map, contact sheets and parameters against plain loops."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from boxwright.functions import presets
from boxwright.plans import playback


def grid(s, e, step):
    if e <= s:
        return [s]
    out = [round(s + i * step, 3) for i in range(int((e - s + 1e-9) / step) + 1)]
    return out + [e] if out[-1] < e - 1e-9 else out


def test_sheet_times_are_steps_and_the_end(spark):
    spans = [(1, 0.0, 1.0), (2, 0.0, 1.1), (3, 2.5, 2.5), (4, 3.0, 2.0), (5, 0.333, 9.871), (6, 1.0, 1.001)]
    got = {}
    for r in playback.sheet_times(spark.createDataFrame(spans, "id long, s double, e double"), 0.25).collect():
        got.setdefault(r.id, {})[r.idx] = r.sec
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {k: pytest.approx(grid(s, e, 0.25)) for k, s, e in spans}


def test_nearest_point_takes_the_earlier_on_ties(spark):
    rng = np.random.default_rng(5)
    points = [(k, float(rng.integers(0, 40)) / 4, 0, i) for i, k in enumerate(rng.integers(0, 4, 60).tolist())]
    points = [(k, t, int(t * 30), i) for k, t, _, i in points]
    times = [(k, i, t) for k in range(5) for i, t in enumerate([0.0, 0.125, 3.0, 3.125, 7.3, 50.0])]
    got = playback.nearest_point(spark.createDataFrame(times, "k long, idx int, sec double"), spark.createDataFrame(points, "k long, t double, frame long, event_id long"), ["k"]).collect()
    assert len(got) == len(times)  # key 4 has no points: its times stay, without one
    for r in got:
        mine = [p for p in points if p[0] == r.k]
        want = min(mine, key=lambda p: (abs(p[1] - r.sec), p[2], p[3]), default=None)
        assert (r.p and r.p.event_id) == (want and want[3])


def test_no_window_of_sheet_times_runs_to_the_end_at_each_row(spark):
    """Such a frame starts anew at each row, so a long event costs its length squared."""
    d = playback.contact_sheet_times(spark, "/root/testdata/sf0.001")
    plan = d._jdf.queryExecution().executedPlan().toString().lower()
    assert "unboundedpreceding$(), currentrow$()" in plan and "currentrow$(), unboundedfollowing" not in plan


def test_slices_count_frames_where_the_videos_rows_are_dealt(spark):
    """Frames are counted and held against their video's bounds in one shuffle, of a number of partitions that goes by the rows."""
    plan = playback.timeline_slices(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and not __import__("re").search(r"hashpartitioning\(video_id#\d+L, (f|frame)#", plan)


def test_parameters_are_asked_for_or_preset(spark):
    rows = [("legacy", None, None, None), ("privacy", 9, False, 0), ("fast_review", 0, None, 2), ("legacy", None, True, 10)]
    d = spark.createDataFrame(rows, "mode string, interval int, mask_review boolean, mask_scale_divisor int")
    asked = {c: F.col(c) for c in ("interval", "mask_review", "mask_scale_divisor")}
    got = d.select(*[c.alias(n) for n, c in presets.resolve(F.col("mode"), asked).items()]).collect()
    assert [(r.interval, r.mask_review, r.mask_scale_divisor) for r in got] == [(5, False, 8), (9, True, 8), (0, True, 4), (5, True, 10)]
    assert [(r.conf, r.imgsz, r.fast_identity, r.detect_batch) for r in got] == [(0.35, 1280, False, 1), (0.20, 1536, False, 1), (0.23, 1280, True, 1), (0.35, 1280, False, 1)]
    with pytest.raises(PySparkException, match="unknown mode"):
        spark.createDataFrame([("fast",)], "mode string").select(presets.resolve(F.col("mode"), {})["conf"]).collect()
