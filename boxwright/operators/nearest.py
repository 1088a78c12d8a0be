"""The best successors of segments by nearness in time and place, without all pairs of a time window.

A pair scores 0.6 * exp(-gap / 3) + 0.4 * max(0, 1 - distance / (4 * side)), so what lies beyond a reach in time or
place scores a known bound at most. Segments are dealt into blocks of time and place, what they may meet is copied into
the blocks within reach, and a segment is done once its last place is above the bound. The others look on with a
doubled reach. Reach comes from the density, so a block holds about as many rows whatever the size of the input.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut
from . import rangejoin

#: Weights and decay of the score, and how far before an end a successor may begin.
NEAR, FAR, DECAY, SLACK, SIDES = 0.6, 0.4, 3.0, 0.05, 4.0
#: Seconds within which those that place doesn't limit look first.
SOON = 6.0
BOX = ["x1", "y1", "x2", "y2"]
COLUMNS = ["track", "seg", "t", *BOX]
FOUND = "q_track long, q_seg long, o_track long, o_seg long, rank int, score double"
#: Pairs that are scored at once.
MATRIX = 1 << 18


def top_links(queries: DataFrame, others: DataFrame, k: int, max_gap: float, digits: int = 9, least: float | None = None, backward: bool = False) -> DataFrame:
    """The k best of others for each of queries: q_track, q_seg, o_track, o_seg, rank, score.

    Both have COLUMNS. Forward, t of queries is their end and t of others their start, with start from end - SLACK to
    end + max_gap; backward, queries begin and others end. Ranks are by the score of so many digits, then by track and
    seg; a segment doesn't meet itself; scores are `least` at least, where it is given.
    """
    queries, others = cut(queries.select(*COLUMNS)), cut(others.select(*COLUMNS))
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(1.0))
    both = queries.select(*BOX).unionByName(others.select(*BOX)).agg(F.max(side).alias("side"), F.min(cx).alias("x0"), F.max(cx).alias("x1"), F.min(cy).alias("y0"), F.max(cy).alias("y1")).first()
    m = others.agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1")).first()
    out, rest = None, queries
    if m.n and both.side:
        # so many of the whole density are meant to score above 1 - short
        density = m.n / max(m.t1 - m.t0, 1e-3) / max((both.x1 - both.x0) * (both.y1 - both.y0), 1.0)
        short = (NEAR * max(2.0 * k, 30.0) / (density * math.pi * (8.0 * both.side) ** 2)) ** (1 / 3)
        while short < FAR:  # beyond, place is no limit
            found = cut(_round(rest, others, k, max_gap, digits, least, backward, short, both, m, out is not None))
            done = found.filter("rank > 0")
            out = done if out is None else out.unionByName(done)
            rest = cut(rest.join(found.filter("rank = 0").select(F.col("q_track").alias("track"), F.col("q_seg").alias("seg")), ["track", "seg"], "left_semi"))
            if rest.isEmpty():
                return out
            short *= 2
    if max_gap > SOON:  # who finds k successors soon that no later one reaches, or has no later ones, looks no further
        found = cut(_by_time(rest, others, k, SOON, digits, least, backward))
        full = found.groupBy("q_track", "q_seg").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).filter((F.col("n") == k) & (F.col("score") > NEAR * math.exp(-SOON / DECAY) + FAR + 2 * 10.0**-digits))
        full = full.select(F.col("q_track").alias("track"), F.col("q_seg").alias("seg"))
        if m.n:
            full = full.unionByName(rest.filter(F.col("t") <= m.t0 + SOON if backward else F.col("t") >= m.t1 - SOON).select("track", "seg")).distinct()
        full = cut(full)
        done = found.join(full.withColumnsRenamed({"track": "q_track", "seg": "q_seg"}), ["q_track", "q_seg"], "left_semi")
        out = done if out is None else out.unionByName(done)
        rest = cut(rest.join(full, ["track", "seg"], "left_anti"))
    last = _by_time(rest, others, k, max_gap, digits, least, backward)
    return last if out is None else out.unionByName(last)


def _round(queries, others, k, max_gap, digits, least, backward, short, both, m, later):
    """Links of the queries that are done within reach, and a row of rank 0 for each of the others."""
    side = both.side
    reach, until = short * SIDES / FAR * side, min(max_gap, -DECAY * math.log(1 - short / NEAR))
    width, sign = 2 * reach, -1 if backward else 1
    cell = lambda c, by: F.floor(c / F.lit(by))
    cx, cy, t = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, F.col("t") * sign
    q = queries.withColumns({"bt": cell(t, until), "bx": cell(cx, width), "by": cell(cy, width)})
    spread = lambda lo, hi, by: F.explode(F.sequence(cell(lo, by), cell(hi, by)))
    o = others.withColumn("bt", spread(t - until, t + 2 * SLACK, until)).withColumn("bx", spread(cx - reach, cx + reach, width)).withColumn("by", spread(cy - reach, cy + reach, width))
    if later:  # few blocks are left
        o = o.join(q.select("bt", "bx", "by").distinct(), ["bt", "bx", "by"], "left_semi")
    beyond_place = NEAR + FAR * max(0.0, 1 - reach / (SIDES * side)) if reach < max(both.x1 - both.x0, both.y1 - both.y0) else -1.0
    beyond_time = -1.0 if until >= max_gap else NEAR * math.exp(-until / DECAY) + FAR
    last = -m.t0 if backward else m.t1
    margin, scale = 2 * 10.0**-digits, 10.0**digits

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return _frame([], [], [], [], [], [])
        parts, b = [], b.sort_values(["track", "seg"], kind="stable")
        for at in range(0, len(a), step := max(1, MATRIX // max(1, len(b)))):
            parts.append(_best(a.iloc[at : at + step], b, k, max_gap, scale, least, backward, beyond_place, beyond_time, last - until, margin))
        return pd.concat(parts)

    keep = [*COLUMNS, "bt", "bx", "by"]
    return q.select(*keep).groupBy("bt", "bx", "by").cogroup(o.select(*keep).groupBy("bt", "bx", "by")).applyInPandas(run, FOUND)


def _frame(*columns) -> pd.DataFrame:
    names = ("q_track", "q_seg", "o_track", "o_seg", "rank", "score")
    types = ("int64", "int64", "int64", "int64", "int32", "float64")
    return pd.DataFrame({n: np.asarray(c, t) for n, c, t in zip(names, columns, types, strict=True)})


def _best(a, b, k, max_gap, scale, least, backward, beyond_place, beyond_time, ends, margin) -> pd.DataFrame:
    """The k best of b for each row of a by dense scores, or rank 0 where something beyond could be among them."""
    col = lambda d, c, axis: np.expand_dims(d[c].to_numpy(), axis)
    end, start = (col(b, "t", 0), col(a, "t", 1)) if backward else (col(a, "t", 1), col(b, "t", 0))
    gap = start - end
    valid = (start >= end - SLACK) & (start <= end + max_gap) & ((col(a, "track", 1) != col(b, "track", 0)) | (col(a, "seg", 1) != col(b, "seg", 0)))
    side = lambda d, axis: np.maximum(1.0, np.maximum(col(d, "x2", axis) - col(d, "x1", axis), col(d, "y2", axis) - col(d, "y1", axis)))
    middle = lambda d, c, axis: col(d, f"{c}1", axis) + col(d, f"{c}2", axis)
    away = np.sqrt(((middle(a, "x", 1) - middle(b, "x", 0)) / 2) ** 2 + ((middle(a, "y", 1) - middle(b, "y", 0)) / 2) ** 2) / np.maximum(side(a, 1), side(b, 0))
    score = NEAR * np.exp(np.maximum(gap, 0.0) / -DECAY) + FAR * np.maximum(0.0, 1 - away / SIDES)
    if least is not None:
        valid &= score >= least
    # a whole number for each pair, its digits first and then its place in the order of ids: all differ
    n = len(b)
    key = np.where(valid, np.floor(score * scale + 0.5).astype(np.int64) * (1 << 32) + np.arange(n - 1, -1, -1), -1)
    top = -np.sort(-(np.partition(key, n - k, axis=1)[:, n - k :] if n > k else key), axis=1)
    beyond = np.maximum(beyond_place, np.where((-a["t"] if backward else a["t"]).to_numpy() >= ends, -1.0, beyond_time))
    kth = top[:, k - 1] // (1 << 32) / scale if n >= k else np.full(len(a), -1.0)
    kth = np.where(kth < 0, -1.0, kth)
    done = (kth - margin > beyond) | (beyond < 0)
    if least is not None:
        done |= beyond < least
    i, r = np.nonzero((top >= 0) & done[:, None])
    j = n - 1 - top[i, r] % (1 << 32)
    ids = lambda d, at: (d["track"].to_numpy()[at], d["seg"].to_numpy()[at])
    open_ = np.flatnonzero(~done)
    none = np.zeros(len(open_), np.int64)
    return pd.concat([_frame(*ids(a, i), *ids(b, j), r + 1, score[i, j]), _frame(*ids(a, open_), none, none, none, none)])


def scored(queries: DataFrame, others: DataFrame, max_gap: float, backward: bool = False) -> DataFrame:
    """All pairs within max_gap with their score, by buckets of time: for few queries, or few rows."""
    q = queries.select(*[F.col(c).alias(f"q_{c}") for c in COLUMNS])
    o = others.select(*[F.col(c).alias(f"o_{c}") for c in COLUMNS])
    end, start = ("o_t", "q_t") if backward else ("q_t", "o_t")
    lo, hi = (F.col("q_t") - max_gap - SLACK, F.col("q_t") + 2 * SLACK) if backward else (F.col("q_t") - SLACK, F.col("q_t") + max_gap)
    j = rangejoin.range_join(q, o, lo, hi, "o_t", max_gap).filter((F.col("q_track") != F.col("o_track")) | (F.col("q_seg") != F.col("o_seg")))
    j = j.filter(F.col(start).between(F.col(end) - SLACK, F.col(end) + max_gap))
    side = F.greatest(F.lit(1.0), *[F.col(f"{x}_{c}2") - F.col(f"{x}_{c}1") for x in "qo" for c in "xy"])
    part = lambda c: F.pow((F.col(f"q_{c}1") + F.col(f"q_{c}2") - F.col(f"o_{c}1") - F.col(f"o_{c}2")) / 2, F.lit(2))
    away = F.sqrt(part("x") + part("y")) / side
    gap = F.greatest(F.lit(0.0), F.col(start) - F.col(end))
    return j.select("q_track", "q_seg", "o_track", "o_seg", (NEAR * F.exp(-gap / DECAY) + FAR * F.greatest(F.lit(0.0), 1 - away / SIDES)).alias("score"))


def _by_time(queries, others, k, max_gap, digits, least, backward):
    d = scored(queries, others, max_gap, backward)
    if least is not None:
        d = d.filter(F.col("score") >= least)
    w = Window.partitionBy("q_track", "q_seg").orderBy(F.desc(F.round(F.col("score") * F.lit(10.0**digits))), "o_track", "o_seg")
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("q_track", "q_seg", "o_track", "o_seg", "rank", "score")


def within(queries: DataFrame, points: DataFrame, lo: str, hi: str, at: str) -> DataFrame:
    """queries with `inside`, how many points lie from lo to hi, and `first` and `second`, the least points from lo on.

    Points are sorted within buckets of about a thousand, and what crosses a bucket comes from a row for each bucket.
    """
    points, queries = cut(points.select(F.col(at).alias("_v"))), cut(queries)
    m = points.agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("a"), F.max("_v").alias("z")).first()
    width = max(((m.z or 0.0) - (m.a or 0.0)) / max(1, m.n // 1000), 1e-6)
    bucket = lambda d: d.withColumn("_b", F.floor((F.greatest(F.lit(m.a or 0.0), F.least(F.lit(m.z or 0.0), F.col("_v"))) - F.lit(m.a or 0.0)) / F.lit(width)))
    by, along, back = Window.partitionBy("_b"), Window.orderBy("_b"), Window.orderBy(F.desc("_b"))
    before = lambda w, upto: w.rowsBetween(Window.unboundedPreceding, upto)
    p = bucket(points)
    heads = p.groupBy("_b").agg(F.min("_v").alias("_h")).withColumn("_ahead", F.lead("_h").over(along)).drop("_h")
    p = p.withColumn("_n", F.lead("_v").over(by.orderBy("_v"))).join(F.broadcast(heads), "_b").withColumn("_n", F.coalesce("_n", "_ahead", F.lit(float("inf")))).drop("_ahead")
    q = cut(queries.withColumn("_id", F.monotonically_increasing_id()))
    ask = lambda c, kind: bucket(q.select("_id", F.col(c).alias("_v"))).select("_b", "_v", F.lit(kind).alias("_k"), "_id")
    every = cut(p.select("_b", "_v", F.lit(1).alias("_k"), F.struct("_v", "_n").alias("_pt")).unionByName(ask(lo, 0), allowMissingColumns=True).unionByName(ask(hi, 2), allowMissingColumns=True))
    sums = every.groupBy("_b").agg(F.count("_pt").alias("_c"), F.min("_pt").alias("_head"))
    sums = sums.select("_b", F.coalesce(F.sum("_c").over(before(along, -1)), F.lit(0)).alias("_past"), F.last("_head", ignorenulls=True).over(before(back, -1)).alias("_next"))
    e = every.join(F.broadcast(sums), "_b")
    # both windows run from their beginning, so a bucket is passed twice and no more
    e = e.withColumn("_rank", F.col("_past") + F.count("_pt").over(before(by.orderBy("_v", "_k"), 0)))
    e = e.withColumn("_from", F.coalesce(F.last("_pt", ignorenulls=True).over(before(by.orderBy(F.desc("_v"), F.desc("_k"), F.desc("_pt._n")), 0)), "_next")).filter("_k <> 1")
    at = lambda c, kind: F.max(F.when(F.col("_k") == kind, F.col(c)))
    got = e.groupBy("_id").agg((at("_rank", 2) - at("_rank", 0)).alias("inside"), at("_from", 0).alias("_f"))
    return q.join(got, "_id").select(*queries.columns, "inside", F.col("_f._v").alias("first"), F.nullif(F.col("_f._n"), F.lit(float("inf"))).alias("second"))
