"""Small cases of the interval, timeline and review rules with results known by hand."""

import pytest
from pyspark.sql import functions as F

from boxwright.functions import geometry as g
from boxwright.functions import scalars as s
from boxwright.operators import islands as isl
from boxwright.plans import coverage, timeline
from boxwright.sources import tracked


def intervals(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], "video_id long, start_frame long, end_frame long")


def shown(d):
    return sorted((r.start_frame, r.end_frame) for r in d.collect())


@pytest.mark.parametrize("rows, keys, frames, want", [
    ([(45, 60)], (0, 60, 120), 180, [(0, 119)]), ([(3, 12)], (0, 30, 60), 90, [(0, 29)]), ([(82, 88)], (0, 30, 60), 90, [(60, 89)]),
    ([(150, 170)], (0, 120, 240), 360, [(120, 239)]), ([(45, 60)], (0, 60, 119), 300, [(0, 118)]), ([(0, 5), (25, 28), (70, 71)], (0, 30, 60), 90, [(0, 29), (60, 89)]),
])
def test_intervals_grow_to_keyframes(spark, rows, keys, frames, want):
    k = spark.createDataFrame([(1, x) for x in keys], "video_id long, k long")
    assert shown(coverage.snapped(intervals(spark, *rows), k, spark.createDataFrame([(1, frames)], "video_id long, frames long"))) == want


def test_gaps_are_merged_up_to_their_limit(spark):
    assert shown(coverage.merged(intervals(spark, (30, 35), (38, 44), (80, 90)), 5)) == [(30, 44), (80, 90)]
    assert shown(coverage.merged(intervals(spark, (30, 35), (120, 140)), 10)) == [(30, 35), (120, 140)]


def test_runs_plan_and_measure(spark):
    frames = spark.createDataFrame([(1, f) for f in (50, 0, 1, 2, 11, 10, 1)], "video_id long, f long")
    assert shown(isl.runs(frames, ["video_id"], "f")) == [(0, 2), (10, 11), (50, 50)]
    plan = isl.complement(intervals(spark, (10, 19), (40, 49)), ["video_id"], F.lit(100))
    assert sorted((r.start_frame, r.end_frame, r.type) for r in plan.collect()) == [(0, 9, "copy"), (10, 19, "render"), (20, 39, "copy"), (40, 49, "render"), (50, 99, "copy")]
    total = intervals(spark, (0, 0), (10, 19)).agg(F.sum(F.col("end_frame") - F.col("start_frame") + 1)).first()[0]
    assert total == 11


def detections(spark, *rows):
    d = [(1, 1, 0, 1, f, f, 99, *[float(x) for x in b], c) for f, b, c in rows]
    return spark.createDataFrame(d, "video_id long, track_id long, chunk long, part long, frame long, event_id long, vl long, x1 double, y1 double, x2 double, y2 double, conf double")


def test_a_proposal_is_made_dense(spark):
    two = detections(spark, (10, (100, 100, 110, 110), 0.8), (14, (108, 100, 118, 110), 0.9))
    x = timeline.written_out(timeline.spread(two, timeline.KEYS, timeline.FILL, timeline.HOLD), timeline.KEYS).collect()
    assert len(x) == 25 and sorted(r.f for r in x) == list(range(25))
    mid = next(r for r in x if r.f == 12)
    assert (mid.x1, mid.y1, mid.x2, mid.y2) == (104, 100, 114, 110) and abs(mid.conf - 0.85) < 1e-12 and abs(sum(r.conf for r in x) / 25 - 0.85) < 1e-9


def test_a_gap_that_is_too_long_stays_open(spark):
    two = detections(spark, (10, (100, 100, 110, 110), 0.8), (27, (108, 100, 118, 110), 0.9))
    x = timeline.written_out(timeline.spread(two, timeline.KEYS, timeline.FILL, timeline.HOLD), timeline.KEYS)
    assert sorted(r.f for r in x.collect()) == [*range(11), *range(27, 38)]


def test_geometry_and_scores(spark):
    d = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5.0, 0.0, 15.0, 10.0)], "ax1 double, ay1 double, ax2 double, ay2 double, bx1 double, by1 double, bx2 double, by2 double")
    a, b = g.box("a"), g.box("b")
    r = d.select(g.iou(a, b), g.center_ratio(a, b), g.center_continuous(a, b), g.area_ratio(a, b), g.relaxed_iou(F.lit(0.9), F.lit(0.7)), s.temporal_score(F.lit(60.0), 60), s.quality_class(F.lit(3), F.lit(4.333), F.lit(3.0), F.lit(0.9771)), s.timecode(F.lit(3661.5))).first()
    assert abs(r[0] - 1 / 3) < 1e-12 and r[1] == 0.5 and r[2] and r[3] == 1 and abs(r[4] - 0.164) < 1e-12 and abs(r[5] - 0.3679) < 1e-4 and r[6] == "LOW" and r[7] == "01:01:01.500"


def test_presence_splits_behind_three_seconds(spark):
    d = spark.createDataFrame([(1, i, t) for i, t in enumerate((0.0, 1.0, 4.0, 7.001))], "track_id long, frame long, t double")
    seg = isl.islands(d, ["track_id"], ["frame"], lambda d: d["t"] - d["prev_t"] > 3.0, ["t"])
    assert [r.seg for r in seg.orderBy("frame").collect()] == [0, 0, 0, 1]


def test_nested_ranges_are_kept(spark):
    raw = spark.createDataFrame([('{"events": [{"event_id": "mask_1", "status": "accepted_ranges", "accepted_ranges": [[1, 1.5], [2, 2.25], [3, 3]]}]}',)], "json string")
    r = tracked.parse_decisions(raw).first()
    assert (r.event_id, r.status) == ("mask_1", "accepted_ranges") and [tuple(x) for x in r.ranges] == [(1.0, 1.5), (2.0, 2.25)]
