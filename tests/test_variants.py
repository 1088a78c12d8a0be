"""Both stitching variants against loops over their verdicts: clusters, events, what each clip costs, and the totals."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from boxwright.plans import behavior, evaluation, identity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def members(spark):
    return identity.variant_members(spark, SF)


def connected(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    out = defaultdict(list)
    for i in ids:
        out[find(i)].append(i)
    return out.values()


def split(group, spans):
    parts = []
    for i in sorted(group, key=lambda i: (spans[i][0], i)):
        p = next((p for p in parts if spans[i][0] >= max(spans[x][1] for x in p) - 0.05), None)
        if p is None:
            parts.append([i])
        else:
            p.append(i)
    return [frozenset(p) for p in parts]


def test_clusters_of_both_variants(spark, members):
    spans = {r.piece: (r.t0, r.t1) for r in identity.profiles(spark, SF).collect()}
    links = {"v1_greedy": [(r.from_id, r.to_id) for r in identity.greedy(spark, SF).collect()], "v2_graph": [(r.from_id, r.to_id) for r in identity.decided(spark, SF).filter("accepted").collect()]}
    got = defaultdict(lambda: defaultdict(set))
    for r in members.collect():
        got[r.variant][r.cluster, r.part].add(r.piece)
    for variant, pairs in links.items():
        want = {p for g in connected(spans, pairs) for p in split(g, spans)}
        assert {frozenset(x) for x in got[variant].values()} == want


def overlap(a, b):
    return (min(a[2], b[2]) - max(a[0], b[0])), (min(a[3], b[3]) - max(a[1], b[1]))


def continuous(a, b):
    w, h = overlap(a, b)
    inter = max(0.0, w) * max(0.0, h)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    dist = (((a[0] + a[2] - b[0] - b[2]) / 2) ** 2 + ((a[1] + a[3] - b[1] - b[3]) / 2) ** 2) ** 0.5
    ref = max(((x[2] - x[0]) ** 2 + (x[3] - x[1]) ** 2) ** 0.5 for x in (a, b))
    return inter / union >= 0.2 or dist <= 1.5 * ref


def test_events_of_both_variants(spark, members):
    dets = defaultdict(list)
    for r in identity.pieces(spark, SF).collect():
        dets[r.piece].append(r)
    parts = defaultdict(list)
    for r in members.collect():
        parts[r.variant, r.cluster, r.part].append(r.piece)
    want = set()
    for key, pieces in parts.items():
        rows = sorted((d for p in pieces for d in dets[p]), key=lambda d: (d.t, d.frame, d.event_id))
        chunks = [[rows[0]]]
        for a, b in zip(rows, rows[1:], strict=False):
            box = lambda r: (r.x1, r.y1, r.x2, r.y2)
            if b.t - a.t > 8.0 or b.piece != a.piece or not continuous(box(a), box(b)):
                chunks.append([])
            chunks[-1].append(b)
        want |= {(*key, len(c), min(d.piece for d in c), round(max(d.conf for d in c), 4), len(pieces)) for c in chunks}
    e = behavior.stitched_events(spark, SF, members).collect()
    got = {(r.variant, r.cluster, r.part, r.n, r.primary_piece, round(r.peak, 4), r.identity_pieces) for r in e}
    assert got == want
    assert all(("identity_stitch:%d" % r.identity_pieces in r.hints) == (r.identity_pieces > 1) and ("cross_presence_span" in r.hints) == (r.presence_segments > 1) for r in e)
    nums = defaultdict(list)
    for r in e:
        nums[r.variant, r.video_id].append(r.num)
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in nums.values())


LONG = "variant string, video_id long, pred_id long, tier string, start_time double, end_time double"
TRUE = "gt_id long, video_id long, start_time double, end_time double, should_mask boolean"


def costs(gt, pred):
    """Objective of every clip by plain loops; videos are as long as their last event says."""
    out = {}
    for video in {g[1] for g in gt} | {p[1] for p in pred}:
        dur = max([g[3] for g in gt if g[1] == video] + [p[5] for p in pred if p[1] == video])
        size = max(10.0, min(45.0, dur / 30))
        for variant in {p[0] for p in pred if p[1] == video}:
            c = 0
            while c * size < dur - 0.01:
                lo, hi = c * size, min(dur, (c + 1) * size)
                mine = [g for g in gt if g[1] == video and g[4] and g[3] > g[2] and g[3] > lo and g[2] < hi]
                every = [p for p in pred if p[:2] == (variant, video) and p[5] > lo and p[4] < hi]
                shown = [p for p in every if p[3] != "low_conf" and p[5] > p[4]]
                times = range(round(lo * 10 + 1e-9), round(hi * 10 + 1e-9) + 1)
                on = lambda rows, k, t: any(r[k] <= t / 10 + 1e-7 and t / 10 - 1e-7 <= r[k + 1] for r in rows)
                g, p = ([on(rows, k, t) for t in times] for rows, k in ((mine, 2), (shown, 4)))
                big = [(x, y) for x in mine for y in shown if (min(x[3], y[5]) - max(x[2], y[4])) / (x[3] - x[2]) >= 0.25]
                merges = sum(len([1 for x, y in big if y == q]) > 1 for q in {y for _, y in big})
                splits = sum(len([1 for x, y in big if x == q]) > 1 for q in {x for x, _ in big})
                review = sum(x[3] == "review" for x in every)
                out[variant, video, c] = (round(0.1 * sum(b and not a for a, b in zip(g, p, strict=True)), 3), round(0.1 * sum(a and not b for a, b in zip(g, p, strict=True)), 3), merges, splits, len(every), review, round(review / 2, 2))
                c += 1
    return out


def test_objectives_over_short_and_long_videos(spark):
    """Videos of 100 and 900 seconds: nothing is left off behind three minutes."""
    gt = [(1, 1, 3.0, 9.5, True), (2, 1, 95.0, 100.0, True), (3, 2, 179.0, 181.0, True), (4, 2, 181.0, 190.0, True), (5, 2, 500.0, 530.0, True), (6, 2, 890.0, 900.0, True), (7, 2, 10.0, 10.0, True), (8, 2, 20.0, 40.0, False)]
    pred = [(v, *p) for v in ("v1_greedy", "v2_graph") for p in [(1, 1, "auto", 2.5, 9.0), (1, 2, "low_conf", 94.0, 99.0), (2, 3, "review", 178.5, 195.0), (2, 4, "auto", 499.0, 510.0), (2, 5, "review", 511.0, 531.0), (2, 6, "auto", 880.0, 899.5)]] + [("v2_graph", 2, 7, "auto", 700.0, 702.0)]
    case = evaluation.Case(spark.createDataFrame(gt, TRUE), spark.createDataFrame(pred, LONG))
    got = {(r.variant, r.video_id, r.clip): (r.false_sec, r.miss_sec, r.merges, r.splits, r.events, r.review_events, r.minutes) for r in evaluation.objectives(spark, SF, case).collect()}
    assert got == costs(gt, pred)
    roll = {r.variant: r for r in evaluation.compared(evaluation.objectives(spark, SF, case), "v1_greedy", "v2_graph").collect()}
    for v in ("v1_greedy", "v2_graph"):
        mine = [x for k, x in got.items() if k[0] == v]
        assert roll[v].clip_count == len(mine) and roll[v].total_events == sum(x[4] for x in mine)
        assert roll[v].mean_objective_score == pytest.approx(sum(x[0] + x[1] + 2 * x[6] for x in mine) / len(mine), abs=6e-4)
    assert roll["delta"].total_events == 1 and "recommended: v1_greedy" in roll


def test_variants_of_the_data(spark, members):
    case = evaluation.stitched(spark, SF)
    gt = [(0, r.video_id, r.start_time, r.end_time, True) for r in case.gt.collect()]
    pred = [(r.variant, r.video_id, r.pred_id, r.tier, r.start_time, r.end_time) for r in case.pred.collect()]
    gt = [(i, *g[1:]) for i, g in enumerate(gt)]
    got = {(r.variant, r.video_id, r.clip): (r.false_sec, r.miss_sec, r.merges, r.splits, r.events, r.review_events, r.minutes) for r in evaluation.objectives(spark, SF, case).collect()}
    assert got == costs(gt, pred)


def test_rules_of_a_ground_truth(spark):
    events = spark.createDataFrame([(1, 1, 0.0, 1.0, True), (1, 2, None, 1.0, False), (1, 3, 2.0, None, None), (1, 4, 2.0, 2.0, True), (1, 5, 2.0, 1.0, False)], "video_id long, gt_id long, start_time double, end_time double, should_mask boolean")
    clips = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, None, 10.0, 20.0), (1, 2, 20.0, 20.0)], "video_id long, clip long, c0 double, c1 double")
    docs = spark.createDataFrame([(1, 0.0, None), (2, 0.0, ""), (3, 5.0, None), (None, 1.0, None)], "video_id long, duration_sec double, clips_ref string")
    got = sorted((r.part, str(r.video_id), str(r.item), r.violation) for r in evaluation.violations(events, clips, docs).collect())
    bare = "ground truth must include events, clips[], duration_sec, or clips_ref"
    assert got == sorted([("events", "1", "2", "missing start_time/end_time"), ("events", "1", "3", "missing start_time/end_time"), ("events", "1", "3", "invalid interval"), ("events", "1", "4", "invalid interval"), ("clips", "1", "None", "missing clip_id"), ("clips", "1", "2", "invalid interval"), ("document", "2", "None", bare), ("document", "None", "None", "missing video path")])


def test_rounds_of_joins_equal_the_loop(spark):
    """Ties, and a chain of pairs each of which waits for the next, longer than the rounds."""
    from boxwright.operators import matching

    chain = [(2, i // 2, (i + 1) // 2, 0.9 - 0.01 * (60 - i)) for i in range(60)]
    ties = [(1, a, b, round((a * b % 3) / 3, 4)) for a in range(7) for b in range(6)]
    d = spark.createDataFrame(chain + ties, "part long, a long, b long, score double")
    want, used = set(), set()
    for part, a, b, s in sorted(chain + ties, key=lambda x: (-x[3], x[1], x[2])):
        if not {(part, "a", a), (part, "b", b)} & used:
            used |= {(part, "a", a), (part, "b", b)}
            want.add((part, a, b, s))
    for rounds in (1, 3, 60):
        assert {tuple(r) for r in matching.dominant_pairs(d, ["part"], "a", "b", "score", rounds).collect()} == want


def test_keys_of_frames_and_parts(spark):
    """Frame 5400 of one video isn't frame 0 of the next, and the parts of a track don't meet the next track's."""
    from boxwright.operators import matching
    from boxwright.plans.registry import part_id

    boxes = spark.createDataFrame([(0, 5400, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 0, 2, 0.8, 0.0, 0.0, 10.0, 10.0)], "video_id long, frame long, event_id long, conf double, x1 double, y1 double, x2 double, y2 double")
    assert matching.suppress(boxes, ["video_id", "frame"]).count() == 2
    ids = spark.range(2).selectExpr("id as track_id", "explode(sequence(0L, 1200L)) as part").select(part_id("track_id", "part").alias("i"))
    assert ids.distinct().count() == 2402
    with pytest.raises(Exception, match="more than"):
        spark.range(1).selectExpr("1L as track_id", "1048576L as part").select(part_id("track_id", "part")).collect()


def test_masks_of_a_clip_are_counted_without_a_row_for_each_step(spark):
    gt = [(i, 1, 0.5 * i, 0.5 * i + 3.0, True) for i in range(40)]
    pred = [("a", 1, i, "auto", 0.7 * i, 0.7 * i + 0.33) for i in range(30)] + [("b", 1, 0, "low_conf", 0.0, 9.0)]
    case = evaluation.Case(spark.createDataFrame(gt, "gt_id long, video_id long, start_time double, end_time double, should_mask boolean"), spark.createDataFrame(pred, "variant string, video_id long, pred_id long, tier string, start_time double, end_time double"))
    d = evaluation.masks(spark, SF, case)
    rows = d.collect()
    tenths = lambda spans, c0, c1: {k for a, z in spans for k in range(-(-int(round(a * 1e6)) // 100000), int(round(z * 1e6)) // 100000 + 1) if round(c0 * 10) <= k <= round(c1 * 10)}
    bounds = {r.clip: (r.c0, r.c1) for r in evaluation.clips(case).collect()}
    assert len(rows) == 2 * len(bounds)
    for r in rows:
        c0, c1 = bounds[r.clip]
        g = tenths([x[2:4] for x in gt if x[3] > c0 and x[2] < c1], c0, c1)
        p = tenths([x[4:6] for x in pred if x[0] == r.variant == "a" and x[5] > c0 and x[4] < c1], c0, c1)
        assert (r.gt_n, r.pred_n, r.false_n, r.miss_n) == (len(g), len(p), len(p - g), len(g - p))
    assert "explode(sequence(lo" not in d._jdf.queryExecution().executedPlan().toString()
    assert evaluation.pairs(spark, SF, case)._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2
