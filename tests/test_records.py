from pyspark.sql import functions as F

from boxwright.functions import records


def test_trajectories_and_their_folds(spark):
    rows = [(1, 1, 9, 0.3, 2.0, 0.5), (1, 1, 4, 0.1, 0.0, 0.9), (1, 1, 5, 0.15, 1.0, 0.9), (1, 2, 30, 1.0, 3.0, 0.95), (2, 1, 7, 0.2, 4.0, 0.4)]
    d = spark.createDataFrame([(k, s, f, f * 10, t, x, 0.0, x + 10, 10.0, c) for k, s, f, t, x, c in rows], "k long, s long, frame long, event_id long, t double, x1 double, y1 double, x2 double, y2 double, conf double")
    parts = records.with_trajectories(d, ["k", "s"])
    got = {(r.k, r.s): [(p.t, p.frame, p.bbox[0], p.conf) for p in r.trajectory] for r in parts.collect()}
    assert got[1, 1] == [(0.1, 4, 0.0, 0.9), (0.15, 5, 1.0, 0.9), (0.3, 9, 2.0, 0.5)] and got[2, 1] == [(0.2, 7, 4.0, 0.4)]
    none = parts.unionByName(spark.createDataFrame([(1, 3), (3, 1)], "k long, s long").withColumn("trajectory", F.lit(None).cast(parts.schema["trajectory"].dataType)))
    tr = F.col("trajectory")
    whole = records.concatenated(none, ["k"], ["s"]).select("k", F.transform(tr, lambda p: p["frame"]).alias("f"), records.first_point(tr)["frame"].alias("a"), records.last_point(tr)["frame"].alias("z"), records.peak_point(tr)["frame"].alias("p"), records.largest_gap(tr).alias("g"))
    assert sorted(map(tuple, whole.collect())) == [(1, [4, 5, 9, 30], 4, 30, 30, 0.7), (2, [7], 7, 7, 7, None), (3, [], None, None, None, None)]
    assert parts.filter("k = 1 and s = 1").select(records.peak_point(tr)["frame"]).first()[0] == 4  # the first of equal ones


def test_hints_keep_the_order_of_their_parts(spark):
    from boxwright.plans.trajectories import hint_union

    rows = [(1, 2, ["edge", "low"]), (1, 1, ["wide", "edge"]), (1, 3, None), (2, 1, ["b", "a", "b"]), (3, 1, []), (4, 2, []), (4, 1, [])]
    d = hint_union(spark.createDataFrame(rows, "k long, o long, hints array<string>"), ["k"], ["o"])
    assert {r.k: r.rule_hints for r in d.collect()} == {1: ["wide", "edge", "low", "behavior_merge:3"], 2: ["b", "a"], 3: [], 4: ["behavior_merge:2"]}
