"""Rules of review, overlays, accessors and discovery on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from boxwright.functions import geometry as g
from boxwright.functions import overlay, reviewing
from boxwright.sources import readers, sinks

POINTS = "array<struct<conf:double,bbox:array<double>>>"


def test_main_review(spark):
    edge = ["edge_partial_face_candidate"]
    rows = [
        (0, "low_conf", 0.9, 1.999, edge, False, "edge_partial_short_aggressive_fallback"), (1, "low_conf", 0.1, 2.0, edge, True, "edge_partial_long"), (2, "auto", None, None, edge, False, "edge_partial_short_aggressive_fallback"),
        (3, "low_conf", 0.70, 0.0, [], True, "low_conf_high_peak"), (4, "low_conf", 0.699, 0.0, ["edge_clip"], True, "low_conf_edge_clip"), (5, "low_conf", 0.599, 9.0, ["edge_clip"], False, "low_conf_below_main_review_threshold"),
        (6, "low_conf", None, 9.0, None, False, "low_conf_below_main_review_threshold"), (7, "review", None, None, None, True, "ordinary_review"), (8, None, 0.1, 0.1, ["edge_clip"], True, "ordinary_review"),
    ]
    d = spark.createDataFrame(rows, "i long, tier string, peak double, seconds double, hints array<string>, keep boolean, reason string")
    got = d.withColumn("v", reviewing.main_review(F.col("tier"), F.col("peak"), F.col("seconds"), F.col("hints")))
    assert got.filter("v.keep != keep or v.reason != reason or v is null").count() == 0


def test_explicit_accept_has_two_rules(spark):
    box = lambda c, *b: [(c, [float(x) for x in b])]
    cases = [  # hints, trajectory, width, height, by the timeline, by the render
        ([], [], 1920, 1080, False, False), (None, None, 1920, 1080, False, False), (["cross_presence_span"], None, 0, 0, True, True), (["low_conf_review_candidate", "x"], [], None, None, True, True),
        (["x"], box(0.55, 500, 500, 600, 600), 1920, 1080, False, False), ([], box(0.549, 500, 500, 600, 600), 0, 0, True, True), ([], box(None, 500, 500, 600, 600), 1920, 1080, False, False),
        ([], box(0.9, 0, 100, 300, 320), 1920, 1080, True, False),  # 0.0318 of the frame, at the left edge
        ([], box(0.9, 0, 100, 300, 350), 1920, 1080, True, True), ([], box(0.9, 100, 100, 500, 500), 1920, 1080, False, False),
        ([], box(0.9, 700, 12, 880, 145), 1920, 1080, False, True), ([], box(0.9, 700, 12.1, 880, 145), 1920, 1080, False, False), ([], box(0.9, 700, 0, 879, 100), 1920, 1080, False, False),
        ([], box(0.9, 0, 0, 900, 900), 0, 1080, False, False), ([], box(0.9, 0, 0, 900), 1920, 1080, False, False), ([], [(0.9, None)], 1920, 1080, False, False),
        ([], box(0.9, 500, 500, 600, 600) + box(0.9, 0, 100, 300, 350), 1920, 1080, True, True),
    ]
    d = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"i long, hints array<string>, tr {POINTS}, w int, h int, a boolean, b boolean")
    rule = lambda render: reviewing.explicit_accept(F.col("hints"), F.col("tr"), F.col("w"), F.col("h"), render)
    got = {r.i: (r.x, r.y) for r in d.select("i", rule(False).alias("x"), rule(True).alias("y")).collect()}
    assert got == {i: c[4:] for i, c in enumerate(cases)}


def test_overlays(spark):
    rows = [(0, 10.0, 10.0, 20.0, 30.0), (1, 0.0, 0.0, 4000.0, 4000.0), (2, 5.5, 6.5, 5.5, 6.5), (3, 2500.0, 3.0, 2600.0, 9.0), (4, -40.0, 3.0, -20.0, 9.0)]
    d = spark.createDataFrame(rows, "i long, x1 double, y1 double, x2 double, y2 double")
    shown = lambda b: {r.i: tuple(r)[1:] for r in d.select("i", *[b[c].alias(c) for c in ("x1", "y1", "x2", "y2")]).collect()}
    grown = shown(overlay.padded(g.box(), 1920, 1080))
    assert grown[0] == (8.0, 6.0, 22.0, 34.0) and grown[1] == (0.0, 0.0, 1919.0, 1079.0)
    whole = shown(overlay.in_pixels(g.box(), 1920, 1080))
    assert whole == {0: (10, 10, 20, 30), 1: (0, 0, 1919, 1079), 2: (6, 6, 7, 7), 3: (1919, 3, 1919, 9), 4: (0, 3, 1, 9)}
    sizes = spark.createDataFrame([(0, 0.3, 0), (1, 0.03, 1), (50, 0.03, 2), (50, 7.0, 50), (100, 0.0, 1), (25, 0.3, 8)], "n int, s double, want int")
    assert sizes.filter(overlay.shrunk(F.col("n"), F.col("s")) != F.col("want")).count() == 0


def test_a_level_that_is_not_known_ends_the_job(spark):
    d = spark.createDataFrame([("low",), ("high",)], "level string")
    assert sorted(r[0] for r in d.select(overlay.mosaic_share(F.col("level"))).collect()) == [0.08, 0.3]
    for bad in ("High", None):
        with pytest.raises(Exception, match="unknown mosaic level"):
            spark.createDataFrame([(bad,)], "level string").select(overlay.mosaic_share(F.col("level"))).collect()


def test_names_of_bounds(spark):
    rows = [(1.0, 3.0, 9.0, 9.0, 2.0), (None, None, 2.0, 5.0, 3.0), (None, 4.0, None, None, 4.0), (None, None, None, None, 0.0), (5.0, None, None, 2.0, 0.0)]
    d = spark.createDataFrame(rows, "start_time double, end_time double, start double, end double, want double")
    assert d.filter(reviewing.event_seconds() != F.col("want")).count() == 0


def test_pending_rows_need_an_entry(spark):
    rows = spark.createDataFrame([(1, "a", True), (1, "b", True), (1, "c", False), (2, "a", True)], "v long, id string, keep boolean")
    entries = spark.createDataFrame([(1, "a"), (1, "a"), (1, "c")], "v long, id string")
    pending, suppressed = sinks.review_pack(rows, entries, ["v", "id"], "keep")
    assert [(r.v, r.id) for r in pending.collect()] == [(1, "a")] and [(r.v, r.id) for r in suppressed.collect()] == [(1, "c")]


def test_discovery_by_extension(spark, tmp_path):
    for name in ("b.MP4", "a.mov", "x/y/c.ts", "x/notes.txt", "x/mp4", "d.mp4.part", "z.wmv", "plain"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    d = readers.discover(spark, str(tmp_path))
    assert [r.name for r in d.collect()] == ["a.mov", "b.MP4", "c.ts", "z.wmv"]
    assert "content" not in d.columns
