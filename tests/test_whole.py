import datetime
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxwright.operators import islands, matching
from boxwright.plans import queries as q

LANE = "lane string, start_frame long, end_frame long"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Tracks with ids of every remainder, some detections beyond frame 20000 and second 600."""
    rng = np.random.default_rng(4)
    first = datetime.datetime(2024, 1, 1)
    hours = np.concatenate([rng.uniform(0, 4 * 40, 160), rng.uniform(4 * 690, 4 * 720, 120)])
    rows = [(i, first + datetime.timedelta(hours=float(h)), int(rng.integers(1, 12)), float(rng.integers(0, 100)) / 100, f'{{"k": {int(rng.integers(0, 200))}}}') for i, h in enumerate(hours)]
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double, props string").write.parquet(f"{path}/events.parquet")
    return path


def merged(iv, gap):
    out = []
    for lane in sorted({x[0] for x in iv}):
        for a, b in sorted(x[1:] for x in iv if x[0] == lane):
            if out and out[-1][0] == lane and a - out[-1][2] <= gap:
                out[-1][2] = max(out[-1][2], b)
            else:
                out.append([lane, a, b])
    return [tuple(x) for x in out]


def test_spread_merging_equals_a_loop(spark):
    rng = np.random.default_rng(9)
    iv = [("ab"[int(rng.integers(0, 2))], int(a), int(a + rng.integers(0, n))) for a, n in zip(rng.integers(0, 3000, 200), rng.choice([5, 300], 200, p=[0.9, 0.1]), strict=True)]
    for gap in (1, 16):
        got = islands.coalesce_spread(spark.createDataFrame(iv, LANE), ["lane"], "start_frame", "end_frame", gap, 50)
        assert sorted(map(tuple, got.collect())) == merged(iv, gap)


def test_interval_queries_take_every_track_and_frame(spark, events):
    f = q.faces(spark, events).collect()
    iv = [("low" if r.tier == "low_conf" else "main", r.start_frame, r.end_frame) for r in f]
    want, total = merged(iv, 31), max(x[2] for x in iv) + 1
    assert {r.track_id % 7 for r in f} == set(range(7)) and total > 20_000
    assert sorted(map(tuple, q.whole_merged_intervals(spark, events).collect())) == want
    plan = q.whole_segment_plan(spark, events).collect()
    for lane in ("low", "main"):
        parts = sorted((r.start_frame, r.end_frame) for r in plan if r.lane == lane)
        assert parts[0][0] == 0 and parts[-1][1] == total - 1 and all(a[1] + 1 == b[0] for a, b in zip(parts, parts[1:]))
    assert sorted((r.lane, r.start_frame, r.end_frame) for r in plan if r.type == "render") == want
    snap = sorted(map(tuple, q.whole_keyframe_snap(spark, events).collect()))
    assert snap == [(k, a, b, a // 60 * 60, min(total, (b + 60) // 60 * 60) - 1) for k, a, b in want]
    sweep = {(r.lane, r.gap): (r.intervals, r.frames) for r in q.whole_coverage_sweep(spark, events).collect()}
    for k in q.SWEEP:
        for lane in ("low", "main"):
            m = [x for x in merged(iv, k + 1) if x[0] == lane]
            assert sweep[lane, k] == (len(m), sum(b - a + 1 for _, a, b in m))


def test_evaluation_queries_take_every_track_and_second(spark, events):
    f = q.faces(spark, events).collect()
    gt = {r.track_id: (r.t0, r.t1 + 0.5) for r in f if r.seg == 0}
    pred = {r.track_id * (1 << 20) + r.seg: (r.track_id, r.t0, r.t1 + 0.2) for r in f if r.tier != "low_conf"}
    clips = defaultdict(lambda: [0, 0.0])
    for a, b in gt.values():
        for c in range(int(b // 20) + 1):
            if a < (c + 1) * 20 and b > c * 20:
                clips[c][0] += 1
                clips[c][1] += min(b, (c + 1) * 20) - max(a, c * 20)
    got = {r.clip_id: (r.gt_events, r.overlap_sec) for r in q.whole_clip_overlap(spark, events).collect()}
    assert got == {c: (n, pytest.approx(s, abs=2e-3)) for c, (n, s) in clips.items()}
    big = [(t, p) for p, (t, a, b) in pred.items() if (min(gt[t][1], b) - max(gt[t][0], a)) / (gt[t][1] - gt[t][0]) >= 0.25]
    errors = q.whole_merge_split_errors(spark, events).collect()
    assert sorted(r.id for r in errors if r.kind == "over_merge") == sorted(p for _, p in big)
    best = {}
    for p, (t, a, b) in pred.items():
        iou = max(0.0, min(gt[t][1], b) - max(gt[t][0], a)) / (max(gt[t][1], b) - min(gt[t][0], a))
        if iou >= 0.3:
            best[t] = max(best.get(t, (0, 0)), (round(iou, 4), -p))
    assert sorted((r.gt_id, r.pred_id) for r in q.greedy_matches(spark, events).collect()) == sorted((t, -p) for t, (_, p) in best.items())
    assert {t % 3 for t in best} == {0, 1, 2}
    steps = lambda spans: {s for a, b in spans for s in range(int(np.ceil(round(a * 10, 6))), int(np.floor(round(b * 10, 6))) + 1)}
    g, p = steps(gt.values()), steps(x[1:] for x in pred.values())
    m = q.whole_mask_errors(spark, events).agg(F.sum("gt_steps"), F.sum("pred_steps"), F.sum("false_steps"), F.sum("miss_steps")).first()
    assert tuple(m) == (len(g), len(p), len(p - g), len(g - p)) and max(p) > 6000


def links(spark, events):
    """All candidate links by a nested loop: ((track, seg), (track, seg)) -> (gap, score)."""
    e = defaultdict(list)
    for r in q.presence(spark, events).select("track_id", "seg", "frame", "event_id", "t", *q.BOX).collect():
        e[r.track_id, r.seg].append((r.frame, r.event_id, r.t, *(r[c] for c in q.BOX)))
    one = {k: (min(x[2] for x in v), max(x[2] for x in v), min(v)[3:], max(v)[3:]) for k, v in e.items()}
    out = {}
    for a, (_, t1, _, z) in one.items():
        for b, (t0, _, y, _) in one.items():
            if a != b and -0.05 <= t0 - t1 <= 90:
                dist = np.hypot((z[0] + z[2] - y[0] - y[2]) / 2, (z[1] + z[3] - y[1] - y[3]) / 2)
                ratio = spark_ratio(z, y, dist)
                out[a, b] = (t0 - t1, 0.6 * np.exp(-max(0.0, t0 - t1) / 3) + 0.4 * max(0.0, 1 - ratio / 4))
    return out


def spark_ratio(z, y, dist):
    size = lambda b: max(b[2] - b[0], b[3] - b[1])
    return dist / max(size(z), size(y), 1.0)


def test_successors_reach_as_far_as_the_reference(spark, events):
    want = links(spark, events)
    of = defaultdict(list)
    for (a, b), (gap, score) in want.items():
        of[a].append((-round(score, 9), b, gap))
    got = {(r.from_track, r.from_seg): (r.candidates, r.best, r.least_gap) for r in q.whole_successor_candidates(spark, events).collect()}
    assert got == {a: (len(v), pytest.approx(-min(v)[0], abs=1e-4), pytest.approx(min(x[2] for x in v), abs=1e-3)) for a, v in of.items()}
    top = defaultdict(dict)
    for r in q.whole_top_successors(spark, events).collect():
        top[r.from_track, r.from_seg][r.rank] = (r.to_track, r.to_seg)
    assert top == {a: dict(enumerate((x[1] for x in sorted(v)[:25]), 1)) for a, v in of.items()}
    assert max(map(len, top.values())) == 25 and max(x[2] for v in of.values() for x in v) > 6


def test_assigned_links_are_a_global_optimum(spark, events):
    edges = {(a[0] * (1 << 20) + a[1], b[0] * (1 << 20) + b[1]): round(s, 4) for (a, b), (_, s) in links(spark, events).items() if s >= 0.5}
    rows, cols = ({x: i for i, x in enumerate(sorted({e[k] for e in edges}))} for k in (0, 1))
    w = np.zeros((max(len(rows), len(cols)),) * 2)
    for (a, b), s in edges.items():
        w[rows[a], cols[b]] = s
    got = q.assigned_links(spark, events).collect()
    assert len({r.from_id for r in got}) == len({r.to_id for r in got}) == len(got) and all((r.from_id, r.to_id) in edges for r in got)
    assert sum(r.score for r in got) == pytest.approx(w[np.arange(len(w)), matching.assign(w)].sum(), abs=1e-3)


def test_links_over_track_ranges_share_no_end(spark):
    """Ends that tracks of two ranges of 64 want: the parts are components, not ranges."""
    d = spark.createDataFrame([(1, 1, 9, 0.9), (1, 70, 9, 0.8), (1, 1, 8, 0.85)], "part long, from_id long, to_id long, score double")
    assert sorted((r.from_id, r.to_id) for r in matching.assignment(d, "part").collect()) == [(1, 8), (70, 9)]


def test_sparse_assignment_equals_dense():
    rng = np.random.default_rng(3)
    for _ in range(200):
        w = np.where(rng.random((n := int(rng.integers(1, 14)), n)) < 0.4, rng.integers(0, 12, (n, n)) / 10, 0)
        r, c = np.nonzero(w)
        if len(r):
            r2 = np.unique(r, return_inverse=True)[1]
            x = matching.assign_edges(r2, c, w[r, c])
            assert len(set(r[x])) == len(set(c[x])) == x.sum()
            assert w[r, c][x].sum() == pytest.approx(w[np.arange(n), matching.assign(w)].sum())


def test_time_ranges_held_by_several_orders_count_once(spark, tmp_path):
    """Orders 28,000 apart have the same range: what is merged is the same with every range once and four times."""
    from boxwright.plans import coverage

    rng = np.random.default_rng(8)
    keys = rng.choice(28_000, 600, replace=False).tolist()
    own = {k: int(rng.integers(0, 40)) for k in keys}
    found = []
    for n in (1, 4):
        path = f"{tmp_path}/{n}"
        spark.createDataFrame([(k + 28_000 * i, own[k]) for k in keys for i in range(n)], "o_orderkey long, o_custkey long").repartition(3).write.parquet(f"{path}/orders.parquet")
        found.append(sorted(map(tuple, coverage.merged_time_ranges(spark, path).collect())))
    iv = [(own[k], a, round(a + (k % 7 - 1) * 0.7, 3)) for k in keys for a in [k * 131 % 4000 / 100]]
    want = merged([x for x in iv if x[2] > x[1]], 0.001)
    assert found[0] == found[1] == [(i, pytest.approx(a), pytest.approx(z)) for i, a, z in want] and len(want) < sum(x[2] > x[1] for x in iv)
