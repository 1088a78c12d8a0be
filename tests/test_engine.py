import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxwright.functions import geometry as g
from boxwright.functions import scalars as s
from boxwright.operators import closure, islands, matching, rangejoin
from boxwright.sources import sinks
from boxwright.sources.tracked import parse_decisions

LANE = "lane string, start_frame long, end_frame long"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_runs_and_gap_merge(spark):
    d = spark.createDataFrame([("a", f) for f in (0, 1, 2, 10, 11, 50)], "lane string, frame long")
    assert rows(islands.runs(d, ["lane"], "frame")) == [("a", 0, 2), ("a", 10, 11), ("a", 50, 50)]
    iv = spark.createDataFrame([("a", 30, 35), ("a", 38, 44), ("a", 80, 90), ("b", 30, 35), ("b", 120, 140)], LANE)
    assert rows(islands.coalesce_intervals(iv, ["lane"], "start_frame", "end_frame", 6)) == [("a", 30, 44), ("a", 80, 90), ("b", 30, 35), ("b", 120, 140)]


def test_plan_tiles_the_video(spark):
    iv = spark.createDataFrame([("a", 10, 19), ("a", 40, 49)], LANE)
    got = sorted((r.start_frame, r.end_frame, r.type) for r in islands.complement(iv, ["lane"], F.lit(100)).collect())
    assert got == [(0, 9, "copy"), (10, 19, "render"), (20, 39, "copy"), (40, 49, "render"), (50, 99, "copy")]


def test_presence_split_is_strict(spark):
    d = spark.createDataFrame([(1, i, t) for i, t in enumerate((0.0, 1.0, 4.0, 7.001))], "track_id long, frame long, t double")
    got = islands.islands(d, ["track_id"], ["frame"], lambda d: d["t"] - d["prev_t"] > 3.0, ["t"])
    assert [r.seg for r in got.orderBy("frame").collect()] == [0, 0, 0, 1]


def test_geometry(spark):
    d = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5.0, 0.0, 15.0, 10.0)], "ax1 double, ay1 double, ax2 double, ay2 double, bx1 double, by1 double, bx2 double, by2 double")
    a, b = g.box("a"), g.box("b")
    r = d.select(g.iou(a, b).alias("i"), g.center_ratio(a, b).alias("c"), g.center_continuous(a, b).alias("k"), g.area_ratio(a, b).alias("r"), g.relaxed_iou(F.lit(0.9), F.lit(0.7)).alias("x")).first()
    assert r.i == pytest.approx(1 / 3) and r.c == 0.5 and r.k and r.r == 1 and r.x == pytest.approx(0.164)


def test_scalars(spark):
    r = spark.range(1).select(s.timecode(F.lit(3725.0019)).alias("t"), s.safe_stem(F.lit('a:b"c')).alias("n"), s.frame_rate(F.lit("30000/1001")).alias("f"), s.temporal_score(F.lit(60.0), 60).alias("x"), s.ema(F.array(F.lit(1.0), F.lit(2.0)), 0.5).alias("e"), s.even_sample(F.sequence(F.lit(0), F.lit(10)), 3).alias("k"), s.cosine(F.array(F.lit(1.0)), F.array(F.lit(0.5))).alias("d")).first()
    assert r.t == "01:02:05.001" and r.n == "a_b_c" and abs(r.f - 29.97003) < 1e-4 and abs(r.x - 0.3679) < 1e-4 and r.e == [1.0, 1.5] and r.k == [0, 5, 10] and r.d == 0.5


def test_range_and_asof_joins_equal_nested_loops(spark):
    rng = np.random.default_rng(2)
    a = [(i, float(x)) for i, x in enumerate(rng.uniform(0, 100, 60))]
    b = [(i, float(x)) for i, x in enumerate(rng.uniform(-5, 110, 60))]
    left, right = spark.createDataFrame(a, "a long, at double"), spark.createDataFrame(b, "b long, p double")
    got = rows(rangejoin.range_join(left, right, F.col("at") - 1, F.col("at") + 7, "p", 8.0).select("a", "b"))
    assert got == sorted((i, j) for (i, x), (j, y) in itertools.product(a, b) if x - 1 <= y <= x + 7)
    left, right = left.withColumn("k", F.lit(1)), right.withColumn("k", F.lit(1)).withColumn("v", F.col("p"))
    back = {r.a: r.v for r in rangejoin.asof(left, right, ["k"], "at", "p", "v").collect()}
    ahead = {r.a: r.v for r in rangejoin.asof(left, right, ["k"], "at", "p", "v", forward=True).collect()}
    for i, x in a:
        assert back[i] == max((y for _, y in b if y <= x), default=None)
        assert ahead[i] == min((y for _, y in b if y >= x), default=None)


def test_assignment_is_optimal():
    rng = np.random.default_rng(8)
    for n in (1, 2, 5, 6):
        w = rng.random((n, n)).round(3)
        best = max(sum(w[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        col = matching.assign(w)
        assert sorted(col) == list(range(n)) and w[np.arange(n), col].sum() == pytest.approx(best)


def test_grouped_solvers(spark):
    p = spark.createDataFrame([(1, 1, 10, 0.9), (1, 1, 11, 0.8), (1, 2, 10, 0.85), (1, 2, 11, 0.5)], "k long, a long, b long, s double")
    assert rows(matching.greedy_pairs(p, "k", "a", "b", "s").select("a", "b")) == [(1, 10), (2, 11)]
    m = spark.createDataFrame([(1, 1, 0.0, 5.0), (1, 2, 4.0, 6.0), (1, 3, 4.96, 9.0)], "c long, id long, start double, end double")
    assert rows(matching.first_fit(m, "c").select("id", "part")) == [(1, 0), (2, 1), (3, 0)]
    c = spark.createDataFrame([(1, 0, 0.0, 2.0, 3), (1, 1, 3.0, 3.0, 1), (1, 2, 9.0, 9.0, 1)], "t long, chunk long, start double, end double, n long")
    assert rows(matching.rescue_singletons(c, "t", 1.5).select("chunk", "merged")) == [(0, 0), (1, 0), (2, 1)]


def test_decisions_and_sinks(spark):
    raw = spark.createDataFrame([('{"schema":"v2","evt_1":"confirmed_face","evt_2":{"status":"accepted_ranges","accepted_ranges":[[1,1.5],[2,2.25],[3,3]]},"x_3":"rejected_fp"}',)], "json string")
    got = {r.event_id: r for r in parse_decisions(raw).collect()}
    assert got["evt_1"].status == "accepted" and got["x_3"].status == "rejected" and [tuple(x) for x in got["evt_2"].ranges] == [(1.0, 1.5), (2.0, 2.25)]
    assert {r.event_id for r in parse_decisions(raw, prefixes=("evt_",)).collect()} == {"evt_1", "evt_2"}
    old, new = spark.createDataFrame([("a", "accepted"), ("b", "skipped")], "event_id string, status string"), spark.createDataFrame([("b", "rejected"), ("c", "bogus"), ("d", "accepted")], "event_id string, status string")
    pending = spark.createDataFrame([("b",), ("c",)], "event_id string")
    assert rows(sinks.upsert_decisions(old, new, pending)) == [("a", "accepted"), ("b", "rejected")]
    q = spark.createDataFrame([(1, 0, None), (1, 1, "x"), (1, 2, "x")], "video_id long, idx long, status string")
    assert sinks.next_pending(q, 1).first().idx == 0


def test_bridge_closure(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    pairs = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")
    assert rows(closure.reach(spark.createDataFrame([(1,)], "id long"), pairs)) == [(1,), (2,), (3,)]


def test_entry_names_match_their_sql():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 35
