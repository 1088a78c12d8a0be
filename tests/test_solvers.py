"""Queries without SQL against plain loops, over the driver's smallest tables, and the interval cases of the review plans."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxwright.operators import closure, islands, matching
from boxwright.plans import evaluation, identity, statistics
from boxwright.plans import queries as q
from boxwright.sources.tracked import parse_decisions, tracked

SF = "/root/testdata/sf0.001"


def iou(a, b):
    w, h = max(0.0, min(a[2], b[2]) - max(a[0], b[0])), max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def test_nms_by_frame(spark):
    frames = defaultdict(list)
    for r in tracked(spark, SF).collect():
        frames[r.video_id, r.frame].append((-r.conf, r.event_id, (r.x1, r.y1, r.x2, r.y2)))
    want = set()
    for rows in frames.values():
        kept = []
        for _, i, box in sorted(rows):
            if all(iou(box, k) <= 0.7 for _, k in kept):
                kept.append((i, box))
        want |= {i for i, _ in kept}
    assert {r.event_id for r in q.frame_nms(spark, SF).collect()} == want
    close = spark.createDataFrame([(1, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.8, 0.0, 0.0, 10.0, 9.0), (1, 3, 0.7, 8.0, 0.0, 18.0, 10.0), (2, 4, 0.1, 0.0, 0.0, 1.0, 1.0)], "at long, event_id long, conf double, x1 double, y1 double, x2 double, y2 double")
    assert {r.event_id for r in matching.suppress(close, "at").collect()} == {1, 3, 4}


@pytest.mark.parametrize("few", [0, 3, 32])
def test_nms_is_the_same_by_rows_and_by_loop(spark, few):
    rng = np.random.default_rng(11)
    rows = [(int(f), i, float(rng.integers(0, 4)) / 4, float(x), float(y), float(x + rng.integers(8, 12)), float(y + rng.integers(8, 12))) for i, (f, x, y) in enumerate(zip(rng.integers(0, 40, 300), rng.integers(0, 4, 300), rng.integers(0, 4, 300)))]
    d = spark.createDataFrame(rows, "at long, event_id long, conf double, x1 double, y1 double, x2 double, y2 double")
    want = set()
    for f in range(40):
        kept = []
        for _, i, box in sorted((-r[2], r[1], r[3:]) for r in rows if r[0] == f):
            if all(iou(box, k) <= 0.7 for _, k in kept):
                kept.append((i, box))
        want |= {i for i, _ in kept}
    got = matching.suppress(d, "at", few=few).collect()
    assert {r.event_id for r in got} == want and len(got) == len(want) < len(rows)


def test_first_fit_is_the_same_by_rows_and_by_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), i, float(a) / 4, float(a + n) / 4, int(g) * 2) for i, (g, a, n) in enumerate(zip(rng.integers(0, 30, 200), rng.integers(0, 40, 200), rng.integers(0, 12, 200)))]
    d = spark.createDataFrame(rows, "at long, id long, start double, end double, more long")
    by_loop, mixed, by_rows = (sorted(tuple(r) for r in matching.first_fit(d, "at", few=few).collect()) for few in (0, 4, 128))
    assert by_loop == mixed == by_rows and len(by_loop) == len(rows) and max(r[-1] for r in by_loop) > 1


def test_assignment_takes_lone_edges_and_solves_the_rest_in_parts(spark):
    rows = [(1, 1, 2, 0.5), (2, 3, 4, 0.0), (3, 5, 6, 0.9), (3, 5, 7, 0.8), (3, 8, 6, 0.7), (4, 9, 9, 0.1), (4, 9, 10, 0.2)]
    d = spark.createDataFrame(rows, "part long, from_id long, to_id long, score double")
    want = {(1, 2), (5, 7), (8, 6), (9, 10)}
    for share in (1, 3, 100):
        got = matching.assignment(d, "part", share)
        assert {(r.from_id, r.to_id) for r in got.collect()} == want and got.columns == d.columns
    assert matching.assignment(d, "part", 1).rdd.getNumPartitions() > matching.assignment(d, "part", 100).rdd.getNumPartitions()


def test_merge_decisions_are_an_optimum_of_the_edges_that_pass(spark):
    e = identity.edges(spark, SF).collect()
    good = [(r.from_id, r.to_id, r.combined) for r in e if r.combined >= 0.72 and round(r.spatial, 4) >= 0.45 and round(r.motion, 4) >= 0.30]
    got = identity.merge_decisions_gated(spark, SF).collect()
    assert len({r.from_id for r in got}) == len({r.to_id for r in got}) == len(got) and {(r.from_id, r.to_id) for r in got} <= {x[:2] for x in good}
    rows, cols = ({x: i for i, x in enumerate(sorted({g[k] for g in good}))} for k in (0, 1))
    w = np.zeros((max(len(rows), len(cols), 1),) * 2)
    for a, b, s in good:
        w[rows[a], cols[b]] = s
    assert sum(r.combined for r in got) == pytest.approx(w[np.arange(len(w)), matching.assign(w)].sum(), abs=1e-6)
    best = {}
    for r in e:
        best[r.to_id] = min(best.get(r.to_id, (9, 0)), (-r.combined, r.from_id))
    assert all(r.accepted == (best[r.to_id][1] == r.from_id) for r in got)


def first_fit(members, slack=0.05):
    groups = []
    for start, end, i in sorted(members):
        g = next((g for g in groups if start >= max(x[1] for x in g) - slack), None)
        if g is None:
            groups.append([(start, end, i)])
        else:
            g.append((start, end, i))
    return sorted(sorted(x[2] for x in g) for g in groups)


def test_clusters_are_split_where_they_overlap(spark):
    p = {r.piece: (r.t0, r.t1) for r in identity.profiles(spark, SF).collect()}
    got = defaultdict(lambda: defaultdict(list))
    for r in identity.overlap_split(spark, SF).collect():
        got[r.cluster][r.part].append(r.piece)
    assert sorted(x for c in got.values() for g in c.values() for x in g) == sorted(p)
    for parts in got.values():
        assert sorted(map(sorted, parts.values())) == first_fit([(*p[i], i) for g in parts.values() for i in g])
    ids = identity.identity_clusters(spark, SF).collect()
    assert sorted(int(x) for r in ids for x in r.track_ids.split(",")) == sorted(p)
    for r in ids:
        times = sorted(p[int(x)] for x in r.track_ids.split(","))
        assert all(b[0] >= a[1] - 0.05 for a, b in zip(times, times[1:]))


def test_clip_matches_by_falling_iou(spark):
    pairs = defaultdict(list)
    for r in evaluation.pairs(spark, SF).collect():
        if r.inter / r.hull >= 0.3:
            pairs[r.variant, r.video_id, r.clip].append((-r.inter / r.hull, r.gt_id, r.pred_id))
    want = set()
    for key, rows in pairs.items():
        a, b = set(), set()
        for _, x, y in sorted(rows):
            if x not in a and y not in b:
                a.add(x)
                b.add(y)
                want.add((*key, x, y))
    assert {(r.variant, r.video_id, r.clip, r.gt_id, r.pred_id) for r in evaluation.clip_matches(spark, SF).collect()} == want


def test_boxes_matched_in_turn(spark):
    b, c = (defaultdict(list) for _ in range(2))
    for rows, out in zip(statistics.runs_of_boxes(spark, SF), (b, c), strict=True):
        for r in rows.collect():
            out[r.video_id, r.frame].append((r.event_id, (r.x1, r.y1, r.x2, r.y2)))
    want = set()
    for at, boxes in b.items():
        free = dict(c[at])
        for i, box in sorted(boxes):
            ranked = sorted(((iou(box, v), k) for k, v in free.items()), reverse=True)
            if ranked and ranked[0][0] >= 0.3:
                want.add((i, ranked[0][1]))
                del free[ranked[0][1]]
    assert {(r.base_id, r.cand_id) for r in statistics.frame_box_matches(spark, SF).collect()} == want


def test_singletons_are_rescued_until_nothing_changes(spark):
    chunks = spark.createDataFrame([(1, k, s, e, n) for k, (s, e, n) in enumerate([(0.0, 0.0, 1), (1.2, 1.2, 1), (4.0, 5.0, 3), (6.0, 6.0, 1), (9.0, 9.0, 1)])], "track long, chunk long, start double, end double, n long")
    got = {r.chunk: r.merged for r in matching.rescue_singletons(chunks, "track", 1.5).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}


def test_reach_has_no_limit_of_rounds(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(99, 98)], "a long, b long")
    assert sorted(r.id for r in closure.reach(spark.createDataFrame([(0,)], "id long"), pairs, both_ways=False).collect()) == list(range(31))


def test_decision_lists_and_meta_keys(spark):
    docs = ['{"events":[{"event_id":"evt_1","status":"confirmed_face"},{"event_id":"evt_2","review_status":"rejected_fp"},{"event_id":"evt_3","status":"accepted_ranges","ranges":[[1,1.5],[3,2]]},{"status":"accepted"}]}', '{"schema":"v2","decision_unit":"x","total_review_events":"3","mask_1":{"status":"accepted_ranges","accepted_ranges":[[1,1.5],[2,2.25]]},"evt_9":"skipped"}']
    got = {r.event_id: (r.status, [(x.start, x.end) for x in r.ranges]) for r in parse_decisions(spark.createDataFrame([(d,) for d in docs], "json string")).collect()}
    assert got == {"evt_1": ("accepted", []), "evt_2": ("rejected", []), "evt_3": ("accepted_ranges", [(1.0, 1.5)]), "mask_1": ("accepted_ranges", [(1.0, 1.5), (2.0, 2.25)]), "evt_9": ("skipped", [])}


def test_keyframes_and_plan(spark):
    from boxwright.plans import coverage

    d = spark.createDataFrame([(1, 45, 60)], "video_id long, start_frame long, end_frame long")
    keys = spark.createDataFrame([(1, 0), (1, 60), (1, 120)], "video_id long, k long")
    assert [tuple(r) for r in coverage.snapped(d, keys).collect()] == [(1, 0, 119)]
    plan = islands.complement(spark.createDataFrame([(1, 10, 19), (1, 40, 49)], d.schema), ["video_id"], F.lit(100))
    assert sorted((r.start_frame, r.end_frame, r.type) for r in plan.collect()) == [(0, 9, "copy"), (10, 19, "render"), (20, 39, "copy"), (40, 49, "render"), (50, 99, "copy")]


def _crowded(n, more):
    """Rows that are too many at one end, columns that are too many at the other: chains of links lead through all."""
    rng = np.random.default_rng(12)
    a = np.sort(np.concatenate([rng.uniform(0, n, n), rng.uniform(n - more, n, more)]))
    b = np.sort(np.concatenate([rng.uniform(0, n, n), rng.uniform(0, more, more)]))
    near = np.clip(np.searchsorted(b, a)[:, None] + np.arange(-6, 6), 0, len(b) - 1)
    rows, cols = np.unique(np.stack([np.repeat(np.arange(len(a)), 12), near.ravel()]), axis=1)
    return rows, cols, np.round(0.5 + 0.5 * np.exp(-np.abs(a[rows] - b[cols]) / 8), 4)


def test_crowded_ends_need_no_path_through_the_whole_graph(monkeypatch):
    """Paths alone push 3.3 columns for each edge, after steps 0.1; the sum stays the greatest."""
    rows, cols, weights = _crowded(2500, 250)
    pushed, push = [0], matching.heapq.heappush
    monkeypatch.setattr(matching.heapq, "heappush", lambda heap, x: (pushed.__setitem__(0, pushed[0] + 1), push(heap, x)))
    got = matching.assign_edges(rows, cols, weights)
    assert len(set(rows[got])) == len(set(cols[got])) == got.sum() and pushed[0] < len(rows)
    monkeypatch.setattr(matching, "STEPPED", 1 << 30, raising=False)
    paths = matching.assign_edges(rows, cols, weights)
    assert weights[got].sum() == pytest.approx(weights[paths].sum(), abs=1e-6)


def test_steps_end_at_the_greatest_sum(monkeypatch):
    """Few rows in steps too: against the dense solver, with ties, with whole and with broken weights."""
    rng = np.random.default_rng(6)
    monkeypatch.setattr(matching, "STEPPED", 0, raising=False)
    for k in range(300):
        n, m = (int(x) for x in rng.integers(1, 14, 2))
        w = np.where(rng.random((n, m)) < 0.4, (rng.integers(0, 12, (n, m)) / 10, rng.integers(0, 10_000, (n, m)) / 10_000, rng.random((n, m)))[k % 3], 0)
        r, c = np.nonzero(w)
        if not len(r):
            continue
        r2 = np.unique(r, return_inverse=True)[1]
        got = matching.assign_edges(r2, c, w[r, c])
        whole = np.zeros((max(n, m),) * 2)
        whole[:n, :m] = w
        assert len(set(r[got])) == len(set(c[got])) == got.sum()
        assert w[r, c][got].sum() == pytest.approx(whole[np.arange(len(whole)), matching.assign(whole)].sum(), abs=1e-6)
