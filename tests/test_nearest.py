import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxwright.operators import nearest, rangejoin
from boxwright.plans import queries as q


def _segments(n, seconds, pixels, seed):
    """Ends or starts with whole boxes; many are alike, so scores tie."""
    r = np.random.default_rng(seed)
    x, y = r.integers(0, pixels, n), r.integers(0, pixels, n)
    t = np.round(r.random(n) * seconds, 2)
    return [(int(i % 97), int(i // 97), float(a), float(b), float(c), float(b + 80), float(c + 100)) for i, (a, b, c) in enumerate(zip(t, x, y, strict=True))]


def _loop(queries, others, k, max_gap, digits, least, backward):
    out = set()
    for a in queries:
        found = []
        for b in others:
            end, start = (b[2], a[2]) if backward else (a[2], b[2])
            if start < end - 0.05 or start > end + max_gap or a[:2] == b[:2]:
                continue
            away = math.sqrt(((a[3] + a[5] - b[3] - b[5]) / 2) ** 2 + ((a[4] + a[6] - b[4] - b[6]) / 2) ** 2) / 100
            score = 0.6 * math.exp(-max(0.0, start - end) / 3.0) + 0.4 * max(0.0, 1 - away / 4)
            if least is None or score >= least:
                found.append((-math.floor(score * 10**digits + 0.5), *b[:2], round(score, 7)))
        out |= {(*a[:2], *f[1:3], i + 1, f[3]) for i, f in enumerate(sorted(found)[:k])}
    return out


@pytest.mark.parametrize("seconds, pixels", [(2.0, 200), (40.0, 900), (300.0, 900)])
@pytest.mark.parametrize("k, digits, least, backward", [(1, 9, None, False), (25, 9, None, False), (6, 4, 0.5, False), (1, 9, 0.5, True)])
def test_top_links_are_those_of_a_loop(spark, seconds, pixels, k, digits, least, backward):
    """Dense (blocks alone), middling (some look on) and sparse (by time)."""
    a, b = _segments(400, seconds, pixels, 1), _segments(500, seconds, pixels, 2)
    schema = "track long, seg long, t double, x1 double, y1 double, x2 double, y2 double"
    got = nearest.top_links(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), k, 90.0, digits, least, backward)
    assert {(*r[:5], round(r.score, 7)) for r in got.collect()} == _loop(a, b, k, 90.0, digits, least, backward)


def test_within_counts_and_finds_the_next_points(spark):
    r = np.random.default_rng(3)
    points = np.round(r.random(5000) * 50, 2).tolist()
    lows = [-3.0, 60.0, *np.round(r.random(300) * 52, 2).tolist()]
    p, d = spark.createDataFrame([(v,) for v in points], "v double"), spark.createDataFrame([(v, v + 9) for v in lows], "lo double, hi double")
    for x in nearest.within(d, p, "lo", "hi", "v").collect():
        later = [*sorted(v for v in points if v >= x.lo)[:2], None, None]
        assert (x.inside, x.first, x.second) == (sum(x.lo <= v <= x.hi for v in points), *later[:2])


@pytest.mark.parametrize("name", ["successor_candidates", "top_successors", "mutual_best_links"])
def test_successors_dont_meet_all_segments_of_a_window(spark, tmp_path, monkeypatch, name):
    """4000 segments in 5 s make 8 million pairs; range joins may hold a few for each segment."""
    us = 1_704_067_200_000_000 + (F.col("id") * 7919 % 4000) * 18_000_000
    e = spark.range(4000).select(F.col("id").alias("event_id"), F.timestamp_micros(us.cast("long")).alias("ts"), F.col("id").alias("user_id"), F.lit("view").alias("event_type"), F.lit(50.0).alias("value"), F.lit('{"k": 7}').alias("props"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    met, real = [], rangejoin.range_join

    def counted(*args, **kwargs):
        out = real(*args, **kwargs)
        met.append(out.count())
        return out

    monkeypatch.setattr(rangejoin, "range_join", counted)
    assert q.QUERIES[name](spark, str(tmp_path)).count() > 1000
    assert sum(met) < 400_000
