import random
from collections import defaultdict

import numpy as np
import pytest

from boxwright.operators import chains, matching
from boxwright.plans import identity

SF = "/root/testdata/sf0.001"


def test_long_chains_and_loops(spark):
    rng = random.Random(4)
    ids = rng.sample(range(100_000), 1330)
    parts = [ids[:1000], ids[1000:1003], ids[1003:1005], ids[1005:1305]]
    rings = [ids[1305:1310], ids[1310:1312], ids[1312:1329]]
    links = [x for p in parts for x in zip(p, p[1:], strict=False)] + [x for r in rings for x in zip(r, r[1:] + r[:1], strict=True)] + [(ids[1329], ids[1329])]
    rng.shuffle(links)
    got = {r.node: (r.head, r.place, r.loop) for r in chains.ranked(spark.createDataFrame(links, "u long, v long")).collect()}
    want = {n: (p[0], i, False) for p in parts for i, n in enumerate(p)}
    for r in rings:
        k = r.index(min(r))
        want |= {n: (min(r), i, True) for i, n in enumerate(r[k:] + r[:k])}
    assert got == want
    assert chains.ranked(spark.createDataFrame([], "u long, v long")).collect() == []


@pytest.fixture(scope="module")
def edges(spark):
    return identity.edges(spark, SF).collect()


def dense(good):
    rows, cols = ({x: i for i, x in enumerate(sorted({g[k] for g in good}))} for k in (0, 1))
    w = np.zeros((max(len(rows), len(cols), 1),) * 2)
    for a, b, s in good:
        w[rows[a], cols[b]] = s
    return w[np.arange(len(w)), matching.assign(w)].sum()


def test_decisions_come_after_the_assignment(spark, edges):
    """All edges take part; the limits judge what is taken, for one of five reasons."""
    best, of = {}, {(r.from_id, r.to_id): r for r in edges}
    for r in edges:
        best[r.to_id] = min(best.get(r.to_id, (9, 0)), (-r.combined, r.from_id))
    for arcface in (False, True):
        if arcface:
            of = {(r.from_id, r.to_id): r for r in identity.edges(spark, SF, gap=identity.ARCFACE_GAP).collect()}
            best = {}
            for r in of.values():
                best[r.to_id] = min(best.get(r.to_id, (9, 0)), (-r.combined, r.from_id))
        got = identity.decided(spark, SF, arcface=arcface).collect()
        assert len({r.from_id for r in got}) == len({r.to_id for r in got}) == len(got)
        assert sum(r.combined for r in got) == pytest.approx(dense([(a, b, r.combined) for (a, b), r in of.items()]), abs=1e-6)
        for r in got:
            e, mutual = of[r.from_id, r.to_id], best[r.to_id][1] == r.from_id
            kept = round(e.appearance, 4) >= 0.45 if arcface else round(e.spatial, 4) >= 0.45 and round(e.motion, 4) >= 0.30 and e.gap <= 90.0005
            want = "below_combined_threshold" if r.combined < 0.72 else "not_mutual_best_predecessor" if not mutual else "global_optimal_match" if kept else "below_appearance_threshold" if arcface else "hsv_spatial_motion_gap_filter"
            assert (r.reason, r.accepted) == (want, want == "global_optimal_match")


def walked(members, succ):
    """Members from their heads, in the order of ids, along their successors."""
    inside = {a: b for a, b in succ.items() if a in members and b in members}
    heads = [m for m in sorted(members) if m not in inside.values()] or [min(members)]
    out = []
    for h in heads:
        while h is not None and h not in out:
            out.append(h)
            h = inside.get(h)
    return out + [m for m in sorted(members) if m not in out], inside


def test_clusters_are_in_chain_order(spark):
    p = {r.piece: r for r in identity.profiles(spark, SF).collect()}
    links = [(r.from_id, r.to_id) for r in identity.decided(spark, SF).filter("accepted").collect()]
    # longer chains than the data have: each piece is linked with the next that begins behind its end, in its video
    by = defaultdict(list)
    for r in sorted(p.values(), key=lambda r: (r.t0, r.piece)):
        by[r.video_id].append(r)
    long = []
    for rows in by.values():
        for i, a in enumerate(rows):
            b = next((b for b in rows[i + 1 :] if b.t0 >= a.t1 and b.piece not in {x[1] for x in long}), None)
            if b is not None:
                long.append((a.piece, b.piece))
    for pairs in (links, long):
        table = spark.createDataFrame([(a, b, 0.9) for a, b in pairs], "from_id long, to_id long, combined double")
        rows = identity.clusters(identity.profiles(spark, SF), table).collect()
        assert sorted(x.piece for r in rows for x in r.m) == sorted(p)
        succ = dict(pairs)
        for r in rows:
            order, inside = walked([x.piece for x in r.m], succ)
            assert [x.piece for x in r.m] == order
            assert [(x.from_id, x.to_id) for x in r.chain or []] == [(a, inside[a]) for a in order if a in inside]
        for v in by:
            mine = sorted((r for r in rows if r.video_id == v), key=lambda r: r.identity_id)
            assert [(r.a, r.least) for r in mine] == sorted((r.a, r.least) for r in mine)
    ids = identity.identity_clusters(spark, SF).collect()
    assert sum(r.merge_count for r in ids) == sum(len(r.stitch_chain) for r in ids)
