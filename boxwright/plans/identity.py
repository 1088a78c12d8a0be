"""Identity: track pieces, their profiles, scored successor edges, global assignment, clusters, and the greedy variant.

A video has the tracks of one number of ten. A tracker gives up an id after a long gap, so the units to be linked are
pieces: runs of a track without a gap over PIECE_GAP. Work is keyed by video, and pairs meet by time buckets in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import scalars as s
from ..operators import islands as isl
from ..operators import chains, matching, rangejoin
from ..operators.components import components
from ..sources.shared import cut
from ..sources.tracked import TRACKED_SQL, table, tracked
from .registry import BOX, ORDER, mean_conf, part_id, query, r4

PIECE_GAP, GAP, TOP = 8.0, 90.0, 25
#: Weights of the five scores (fixed values).
WEIGHTS = {"appearance": 0.55, "motion": 0.15, "temporal_soft": 0.15, "spatial": 0.10, "iou_weak": 0.05}
TAU, SCORE_MIN, SPATIAL_MIN, MOTION_MIN = 60.0, 0.72, 0.45, 0.30
V1_GAP, V1_SCORE, V1_APPEARANCE = 60.0, 0.68, 0.72
#: Limits where appearance comes from learned embeddings (fixed values).
ARCFACE_GAP, ARCFACE_MIN = 600.0, 0.45

PIECES_SQL = f"""{TRACKED_SQL},
plag AS (SELECT *, t - lag(t) OVER w AS gap, lag(t) OVER w AS pt, {", ".join(f"lag({c}) OVER w AS q{c}" for c in BOX)} FROM tracked WINDOW w AS (PARTITION BY track_id ORDER BY frame, event_id)),
pieces AS (SELECT *, track_id * 1048576 + CAST(sum(CASE WHEN gap > {PIECE_GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY frame, event_id) AS BIGINT) AS piece FROM plag)"""
VELOCITY_SQL = "CASE WHEN gap > 0 AND gap <= {0} THEN (({1}1 + {1}2) - (q{1}1 + q{1}2)) / 2 / gap ELSE 0.0 END"
PROFILE_SQL = f"""{PIECES_SQL},
moved AS (SELECT *, {VELOCITY_SQL.format(PIECE_GAP, "x")} AS vx, {VELOCITY_SQL.format(PIECE_GAP, "y")} AS vy, row_number() OVER (PARTITION BY piece ORDER BY frame, event_id) AS rn FROM pieces),
vectors AS (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS vec, (SELECT count(*) FROM embeddings) AS n_vec FROM embeddings),
profile AS (SELECT piece, any_value(video_id) AS video_id, any_value(track_id) AS track_id, count(*) AS n, min(t) AS t0, max(t) AS t1, min(frame) AS f0, max(frame) AS f1, max(conf) AS peak, sum(CAST(round(conf * 1000000) AS BIGINT)) / 1000000.0 / count(*) AS mean,
    arg_max(frame, (conf, -frame, -event_id)) AS sample_frame, {", ".join(f"arg_min({c}, (frame, event_id)) AS a{c}, arg_max({c}, (frame, event_id)) AS z{c}" for c in BOX)},
    coalesce(max(CASE WHEN rn = 2 THEN vx END), 0.0) AS evx, coalesce(max(CASE WHEN rn = 2 THEN vy END), 0.0) AS evy,
    CASE WHEN count(*) > 1 THEN arg_max(vx, (frame, event_id)) ELSE 0.0 END AS ovx, CASE WHEN count(*) > 1 THEN arg_max(vy, (frame, event_id)) ELSE 0.0 END AS ovy FROM moved GROUP BY piece)"""


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with the number of their piece."""
    d = isl.islands(tracked(spark, sf_dir), ["track_id"], ORDER, lambda d: d["t"] - d["prev_t"] > PIECE_GAP, ["t", *BOX], "part")
    return d.withColumn("piece", part_id("track_id", "part"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece: bounds, confidence, first and last box, velocity at both ends (one shuffle, by track)."""
    d = pieces(spark, sf_dir).withColumn("gap", F.col("t") - F.col("prev_t"))
    for axis in "xy":
        moved = (F.col(f"{axis}1") + F.col(f"{axis}2") - F.col(f"prev_{axis}1") - F.col(f"prev_{axis}2")) / 2 / F.col("gap")
        d = d.withColumn(f"v{axis}", F.when((F.col("gap") > 0) & (F.col("gap") <= PIECE_GAP), moved).otherwise(0.0))
    d = d.withColumn("rn", F.row_number().over(Window.partitionBy("track_id", "piece").orderBy(*ORDER)))
    key, box, n = F.struct("frame", "event_id"), F.struct(*BOX), F.count(F.lit(1))
    p = d.groupBy("track_id", "piece").agg(
        F.first("video_id").alias("video_id"), n.alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.min("frame").alias("f0"), F.max("frame").alias("f1"), F.max("conf").alias("peak"), mean_conf().alias("mean"),
        F.max_by("frame", F.struct(F.col("conf"), -F.col("frame"), -F.col("event_id"))).alias("sample_frame"), F.min_by(box, key).alias("a"), F.max_by(box, key).alias("z"),
        *[F.coalesce(F.max(F.when(F.col("rn") == 2, F.col(f"v{x}"))), F.lit(0.0)).alias(f"ev{x}") for x in "xy"], *[F.when(n > 1, F.max_by(f"v{x}", key)).otherwise(0.0).alias(f"ov{x}") for x in "xy"],
    )
    return p.select("video_id", "track_id", "piece", "n", "t0", "t1", "f0", "f1", "peak", "mean", "sample_frame", *[F.col(f"{e}.{c}").alias(f"{e}{c}") for e in "az" for c in BOX], "evx", "evy", "ovx", "ovy")


def with_vectors(p: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with a histogram's root, as the table of embeddings has it for the track."""
    e = table(spark, sf_dir, "embeddings")
    n = e.agg(F.count(F.lit(1)).alias("n_vec"))
    vec = e.select(F.col("vec_id").alias("_v"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("vec"))
    return p.crossJoin(F.broadcast(n)).withColumn("_v", F.col("track_id") * 31 % F.col("n_vec")).join(vec, "_v").drop("_v", "n_vec")


@query(f"""WITH {PROFILE_SQL} SELECT video_id, track_id, piece, n AS detection_count, round(t0, 3) AS start_time, round(t1, 3) AS end_time, f0 AS start_frame, f1 AS end_frame, round(t1 - t0, 3) AS duration_sec, round(peak, 4) AS peak_confidence, round(mean, 4) AS avg_confidence, sample_frame,
    {", ".join(f"round({e}{c}, 1) AS {n}_{c}" for e, n in (("a", "first"), ("z", "last")) for c in BOX)}, round(evx, 3) AS entry_vx, round(evy, 3) AS entry_vy, round(ovx, 3) AS exit_vx, round(ovy, 3) AS exit_vy FROM profile""")
def piece_profiles(spark, sf_dir):
    p = profiles(spark, sf_dir)
    return p.select(
        "video_id", "track_id", "piece", F.col("n").alias("detection_count"), r4(F.col("t0"), 3).alias("start_time"), r4(F.col("t1"), 3).alias("end_time"), F.col("f0").alias("start_frame"), F.col("f1").alias("end_frame"),
        r4(F.col("t1") - F.col("t0"), 3).alias("duration_sec"), r4(F.col("peak")).alias("peak_confidence"), r4(F.col("mean")).alias("avg_confidence"), "sample_frame",
        *[r4(F.col(f"{e}{c}"), 1).alias(f"{n}_{c}") for e, n in (("a", "first"), ("z", "last")) for c in BOX], *[r4(F.col(f"{e}v{x}"), 3).alias(f"{n}_v{x}") for e, n in (("e", "entry"), ("o", "exit")) for x in "xy"],
    )


# ---------------------------------------------------------------- scores of a pair: p ends, n begins


def _pair_scores(d: DataFrame) -> DataFrame:
    """gap, appearance, temporal_soft, spatial, motion and iou_weak of rows with p_ and n_ columns."""
    a, b = g.box("p_z"), g.box("n_a")
    gap = F.greatest(F.lit(0.0), F.col("n_t0") - F.col("p_t1"))
    dp, dn = g.diagonal(a), g.diagonal(b)
    ref, big = F.greatest(dp, dn, F.lit(1.0)), F.greatest(dp, dn)
    scale = F.when(big > 0, F.least(dp, dn) / big).otherwise(0.0)
    speed_out, speed_in = F.sqrt(F.col("p_ovx") ** 2 + F.col("p_ovy") ** 2), F.sqrt(F.col("n_evx") ** 2 + F.col("n_evy") ** 2)
    along = (F.col("p_ovx") * F.col("n_evx") + F.col("p_ovy") * F.col("n_evy")) / (speed_out * speed_in)
    velocity = F.when((speed_out > 1e-3) & (speed_in > 1e-3), F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))).otherwise(0.5)
    center = lambda x, k: (x[f"{k}1"] + x[f"{k}2"]) / 2
    miss = F.sqrt((center(a, "x") + F.col("p_ovx") * gap - center(b, "x")) ** 2 + (center(a, "y") + F.col("p_ovy") * gap - center(b, "y")) ** 2)
    place = F.greatest(F.lit(0.0), 1 - miss / (ref * 2.5))
    d = d.withColumn("gap", F.col("n_t0") - F.col("p_t1")).withColumn("appearance", s.bhattacharyya_roots(F.col("p_vec"), F.col("n_vec")))
    d = d.withColumn("temporal_soft", s.temporal_score(F.col("gap"), TAU)).withColumn("dist_ratio", g.center_distance(a, b) / ref).withColumn("place", place).withColumn("velocity", velocity)
    return d.withColumn("spatial", 0.70 * F.greatest(F.lit(0.0), 1 - F.col("dist_ratio") / 3.0) + 0.30 * scale).withColumn("motion", 0.55 * place + 0.45 * velocity).withColumn("iou", g.iou(a, b)).withColumn("iou_weak", F.least(F.lit(1.0), F.col("iou") / 0.30))


_DIAG = {x: f"sqrt(pow({x}x2 - {x}x1, 2) + pow({x}y2 - {x}y1, 2))" for x in ("p.z", "n.a")}
_REF = f"greatest({_DIAG['p.z']}, {_DIAG['n.a']}, 1.0)"
_GAP0 = "greatest(0.0, n.t0 - p.t1)"
_MISS = f"sqrt(pow((p.zx1 + p.zx2) / 2 + p.ovx * {_GAP0} - (n.ax1 + n.ax2) / 2, 2) + pow((p.zy1 + p.zy2) / 2 + p.ovy * {_GAP0} - (n.ay1 + n.ay2) / 2, 2))"
_OUT, _IN = "sqrt(pow(p.ovx, 2) + pow(p.ovy, 2))", "sqrt(pow(n.evx, 2) + pow(n.evy, 2))"


def _pairs_sql(gap: float, more: str = "") -> str:
    return f"""{PROFILE_SQL},
seen AS (SELECT profile.*, vec FROM profile JOIN vectors ON vec_id = track_id * 31 % n_vec),
pair0 AS (SELECT p.video_id, p.track_id AS p_track, n.track_id AS n_track, p.piece AS from_id, n.piece AS to_id, p.t0 AS p_t0, n.t0 AS n_t0, n.t0 - p.t1 AS gap, least(1.0, list_dot_product(p.vec, n.vec)) AS appearance, {g.iou_sql("p.z", "n.a")} AS iou, {g.distance_sql("p.z", "n.a")} / {_REF} AS dist_ratio,
    CASE WHEN greatest({_DIAG["p.z"]}, {_DIAG["n.a"]}) > 0 THEN least({_DIAG["p.z"]}, {_DIAG["n.a"]}) / greatest({_DIAG["p.z"]}, {_DIAG["n.a"]}) ELSE 0.0 END AS scale, greatest(0.0, 1 - {_MISS} / ({_REF} * 2.5)) AS place,
    CASE WHEN {_OUT} > 1e-3 AND {_IN} > 1e-3 THEN greatest(0.0, least(1.0, (p.ovx * n.evx + p.ovy * n.evy) / ({_OUT} * {_IN}))) ELSE 0.5 END AS velocity
    FROM seen p JOIN seen n ON p.video_id = n.video_id AND p.piece <> n.piece AND n.t0 >= p.t1 - 0.05 AND n.t0 <= p.t1 + {gap} {more}),
pair1 AS (SELECT *, CASE WHEN gap < 0 THEN 0.0 ELSE exp(-gap / {TAU}) END AS temporal_soft, 0.70 * greatest(0.0, 1 - dist_ratio / 3.0) + 0.30 * scale AS spatial, 0.55 * place + 0.45 * velocity AS motion, least(1.0, iou / 0.30) AS iou_weak FROM pair0),
pair2 AS (SELECT *, {" + ".join(f"{w} * {c}" for c, w in WEIGHTS.items())} AS combined FROM pair1)"""


def _pairs(spark: SparkSession, sf_dir: str, gap: float, p: DataFrame | None = None) -> DataFrame:
    """Pieces and those that begin at most gap behind their end, in one video; p: profiles that are there already."""
    d = with_vectors(profiles(spark, sf_dir) if p is None else p, spark, sf_dir)
    p = d.select("video_id", *[F.col(c).alias(f"p_{c}") for c in ("piece", "track_id", "t0", "t1", "ovx", "ovy", "vec", *[f"z{c}" for c in BOX])])
    n = d.select("video_id", *[F.col(c).alias(f"n_{c}") for c in ("piece", "track_id", "t0", "evx", "evy", "vec", *[f"a{c}" for c in BOX])])
    return rangejoin.range_join(p, n, F.col("p_t1") - 0.05, F.col("p_t1") + gap, "n_t0", gap, ["video_id"]).filter("p_piece <> n_piece")


def edges(spark: SparkSession, sf_dir: str, p: DataFrame | None = None, gap: float = GAP) -> DataFrame:
    """The TOP best successors of each piece with all scores, unrounded but for combined, which ranks them."""
    d = _pair_scores(_pairs(spark, sf_dir, gap, p))
    combined = sum((w * F.col(c) for c, w in WEIGHTS.items()), F.lit(0.0))
    d = d.withColumn("combined", r4(combined)).withColumnsRenamed({"p_piece": "from_id", "n_piece": "to_id"})
    parts = [F.struct((-w * F.col(c)).alias("w"), F.lit(i).alias("i"), F.lit(c).alias("name")) for i, (c, w) in enumerate(WEIGHTS.items())]
    d = d.withColumn("top_features", F.array_join(F.transform(F.slice(F.array_sort(F.array(*parts)), 1, 3), lambda x: x["name"]), ","))
    order = Window.partitionBy("video_id", "from_id").orderBy(F.desc("combined"), "to_id")
    return d.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP).select("video_id", "from_id", "to_id", "rank", "gap", "combined", *WEIGHTS, "top_features")


_TOP3 = "list_transform(list_sort([" + ", ".join(f"{{'w': -{w} * {c}, 'i': {i}, 'name': '{c}'}}" for i, (c, w) in enumerate(WEIGHTS.items())) + "])[1:3], lambda x: x.name)"


@query(f"""WITH {_pairs_sql(GAP)}, ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id, from_id ORDER BY round(combined, 4) DESC, to_id) AS rank FROM pair2)
SELECT video_id, from_id, to_id, CAST(rank AS INTEGER) AS rank, round(gap, 3) AS gap, round(combined, 4) AS combined, {", ".join(f"round({c}, 4) AS {c}" for c in WEIGHTS)}, array_to_string({_TOP3}, ',') AS top_features FROM ranked WHERE rank <= {TOP}""")
def identity_edges(spark, sf_dir):
    """Successor edges of all pieces: five scores, their sum, the three that weigh most."""
    return edges(spark, sf_dir).select("video_id", "from_id", "to_id", "rank", r4(F.col("gap"), 3).alias("gap"), "combined", *[r4(F.col(c)).alias(c) for c in WEIGHTS], "top_features")


def best_predecessors(d: DataFrame) -> DataFrame:
    order = Window.partitionBy("video_id", "to_id").orderBy(F.desc("combined"), "from_id")
    return d.withColumn("best", F.row_number().over(order) == 1)


@query(f"""WITH {_pairs_sql(GAP)}, ranked AS (SELECT *, round(combined, 4) AS score, row_number() OVER (PARTITION BY video_id, from_id ORDER BY round(combined, 4) DESC, to_id) AS rank FROM pair2),
b AS (SELECT *, row_number() OVER (PARTITION BY video_id, to_id ORDER BY score DESC, from_id) AS q FROM ranked WHERE rank <= {TOP}) SELECT video_id, from_id, to_id, score AS combined FROM b WHERE q = 1""")
def best_predecessor_edges(spark, sf_dir):
    return best_predecessors(edges(spark, sf_dir)).filter("best").select("video_id", "from_id", "to_id", "combined")


def decided(spark: SparkSession, sf_dir: str, gates_first: bool = False, arcface: bool = False, p: DataFrame | None = None) -> DataFrame:
    """Edges that a maximum-weight assignment takes, with the verdict on each and its reason, one of five.

    The assignment sees all edges, and the limits are applied to what it takes: on score, place, motion and gap, or with
    arcface on score and appearance. With gates_first only edges within the limits take part, so one that would be
    refused can't take an end from one that is kept. Connected components share no end, so they are solved apart.
    """
    d = cut(best_predecessors(edges(spark, sf_dir, p, ARCFACE_GAP if arcface else GAP)))
    within = F.col("combined") >= SCORE_MIN
    if arcface:
        within &= r4(F.col("appearance")) >= ARCFACE_MIN
    else:
        within &= (r4(F.col("spatial")) >= SPATIAL_MIN) & (r4(F.col("motion")) >= MOTION_MIN) & (r4(F.col("gap"), 3) <= GAP)
    pool = d.filter(within) if gates_first else d
    u, v = F.col("from_id") * 2, F.col("to_id") * 2 + 1  # a piece's end and its start are two nodes
    roots = components(pool.select(u.alias("u"), v.alias("v")))
    parts = pool.withColumn("node", v).join(roots, "node", "left").withColumn("part", F.coalesce("root", "node"))
    taken = matching.assignment(parts.select("part", "from_id", "to_id", F.col("combined").alias("score")), "part")
    d = taken.select("from_id", "to_id").join(d, ["from_id", "to_id"]).withColumn("accepted", within & F.col("best"))
    other = "below_appearance_threshold" if arcface else "hsv_spatial_motion_gap_filter"
    reason = F.when(F.col("accepted"), "global_optimal_match").when(F.col("combined") < SCORE_MIN, "below_combined_threshold").when(~F.col("best"), "not_mutual_best_predecessor").otherwise(other)
    return d.withColumn("reason", reason)


_VERDICT = ["video_id", "from_id", "to_id", "combined", "gap", "accepted", "reason", "top_features"]


@query()
def merge_decisions(spark, sf_dir):
    """The assignment's verdicts on all edges that it takes (no SQL: tested against a dense solver)."""
    return decided(spark, sf_dir).withColumn("gap", r4(F.col("gap"), 3)).select(*_VERDICT)


@query()
def merge_decisions_gated(spark, sf_dir):
    """The verdicts where the limits come before the assignment (no SQL: tested against a dense solver)."""
    return decided(spark, sf_dir, gates_first=True).withColumn("gap", r4(F.col("gap"), 3)).select(*_VERDICT)


@query()
def merge_decisions_by_appearance(spark, sf_dir):
    """The verdicts by the limits for learned embeddings: score and appearance, gaps up to ten minutes."""
    return decided(spark, sf_dir, arcface=True).withColumn("gap", r4(F.col("gap"), 3)).select(*_VERDICT)


def split_clusters(p: DataFrame, links: DataFrame) -> DataFrame:
    """p (video_id, piece, t0, t1) with cluster (the least piece linked with it) and part (members that don't overlap)."""
    roots = components(links.select(F.col("from_id").alias("u"), F.col("to_id").alias("v")))
    d = p.join(roots.withColumnRenamed("node", "piece"), "piece", "left").select("video_id", "piece", F.col("t0").alias("start"), F.col("t1").alias("end"), F.coalesce("root", "piece").alias("cluster"), F.col("piece").alias("id"))
    alone = d.join(d.groupBy("cluster").count().filter("count > 1").select("cluster"), "cluster", "left_anti").withColumn("part", F.lit(0).cast("long"))
    more = d.join(roots.select(F.col("root").alias("cluster")).distinct(), "cluster", "left_semi")
    return alone.unionByName(matching.first_fit(more.select(*[c for c in alone.columns if c != "part"]), "cluster"))


def chained(members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members (piece, cluster, part) with head and place in their chain, and the links inside with those of their start.

    A cluster's order is its chains one after the other, by their heads' ids; a piece without a link is its own chain.
    """
    one, two = (members.select(F.col("piece").alias(end), F.col("cluster").alias(f"c{k}"), F.col("part").alias(f"p{k}")) for k, end in ((1, "from_id"), (2, "to_id")))
    inside = cut(links.join(one, "from_id").join(two, "to_id").filter("c1 = c2 and p1 = p2").drop("c2", "p2").withColumnsRenamed({"c1": "cluster", "p1": "part"}))
    places = cut(chains.ranked(inside.select(F.col("from_id").alias("u"), F.col("to_id").alias("v"))))
    at = members.join(places.withColumnRenamed("node", "piece"), "piece", "left").withColumns({"head": F.coalesce("head", "piece"), "place": F.coalesce("place", F.lit(0).cast("long"))})
    return at, inside.join(places.withColumnRenamed("node", "from_id"), "from_id")


def clusters(p: DataFrame, links: DataFrame) -> DataFrame:
    """A row for each cluster of profiles p: members in chain order, its links in that order, bounds, number in its video."""
    d = cut(split_clusters(p.select("video_id", "piece", "t0", "t1"), links))
    members, inside = chained(d, links.select("from_id", "to_id", "combined"))
    rows = members.groupBy("video_id", "cluster", "part").agg(F.array_sort(F.collect_list(F.struct("head", "place", "piece"))).alias("m"), F.min("start").alias("a"), F.max("end").alias("z"), F.min("piece").alias("least"))
    edge = F.struct("head", "place", "from_id", "to_id", "combined")
    chain = inside.groupBy("cluster", "part").agg(F.array_sort(F.collect_list(edge)).alias("chain"))
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("a", "least"))
    return rows.withColumn("identity_id", F.format_string("id_%04d", number)).join(chain, ["cluster", "part"], "left")


@query()
def identity_clusters(spark, sf_dir):
    """Clusters of accepted edges, split where members overlap, members in chain order, numbered by start in each video.

    No SQL: tested against loops over the verdicts.
    """
    p = cut(profiles(spark, sf_dir))
    out = clusters(p, cut(decided(spark, sf_dir, p=p).filter("accepted")))
    text = lambda x: x.cast("string")
    stitched = F.transform(F.coalesce("chain", F.array().cast("array<struct<head:long,place:long,from_id:long,to_id:long,combined:double>>")), lambda x: F.struct(x["from_id"].alias("from_id"), x["to_id"].alias("to_id"), x["combined"].alias("combined")))
    return out.select(
        "video_id", "identity_id", F.array_join(F.transform("m", lambda x: text(x["piece"])), ",").alias("track_ids"), F.size("m").alias("track_count"), r4(F.col("a"), 3).alias("start_time"), r4(F.col("z"), 3).alias("end_time"),
        r4(F.col("z") - F.col("a"), 3).alias("duration_sec"), stitched.alias("stitch_chain"), F.size(stitched).alias("merge_count"),
    )


# ---------------------------------------------------------------- the greedy variant

V1_SQL = f"""{_pairs_sql(V1_GAP, "AND (p.t0 < n.t0 OR (p.t0 = n.t0 AND p.piece < n.piece))")},
v1 AS (SELECT *, CASE WHEN iou >= 0.05 OR dist_ratio <= 1.5 THEN 1.0 ELSE greatest(0.0, 1 - dist_ratio / 3) END AS near FROM pair1),
v1s AS (SELECT *, round(0.25 * (1 - gap / {V1_GAP}) + 0.25 * near + 0.40 * appearance + 0.10 * motion, 4) AS score FROM v1 WHERE (dist_ratio <= 1.5 OR round(iou, 4) >= 0.08) AND (place >= 0.25 OR velocity >= 0.6) AND appearance >= {V1_APPEARANCE}),
v1r AS (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY score DESC, n_t0, to_id) AS r FROM v1s WHERE score >= {V1_SCORE})"""


def greedy(spark: SparkSession, sf_dir: str, p: DataFrame | None = None) -> DataFrame:
    """Each piece's best successor by the greedy rules: hard limits on place, motion and appearance, gap at most V1_GAP."""
    d = _pair_scores(_pairs(spark, sf_dir, V1_GAP, p)).filter("p_t0 < n_t0 or (p_t0 = n_t0 and p_piece < n_piece)")
    close = F.col("dist_ratio") <= 1.5
    near = F.when((F.col("iou") >= 0.05) | close, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("dist_ratio") / 3))
    d = d.filter((close | (r4(F.col("iou")) >= 0.08)) & ((F.col("place") >= 0.25) | (F.col("velocity") >= 0.6)) & (F.col("appearance") >= V1_APPEARANCE))
    d = d.withColumn("score", r4(0.25 * (1 - F.col("gap") / V1_GAP) + 0.25 * near + 0.40 * F.col("appearance") + 0.10 * F.col("motion"))).filter(F.col("score") >= V1_SCORE)
    order = Window.partitionBy("p_piece").orderBy(F.desc("score"), "n_t0", "n_piece")
    return d.withColumn("r", F.row_number().over(order)).filter("r = 1").select("video_id", F.col("p_piece").alias("from_id"), F.col("n_piece").alias("to_id"), "score", "gap")


@query(f"WITH {V1_SQL} SELECT video_id, from_id, to_id, score, round(gap, 3) AS gap FROM v1r WHERE r = 1")
def greedy_successors(spark, sf_dir):
    return greedy(spark, sf_dir).withColumn("gap", r4(F.col("gap"), 3))


V1_ROOT_SQL = f"""{V1_SQL}, linked AS (SELECT from_id AS a, to_id AS b FROM v1r WHERE r = 1), two AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT piece AS a, piece AS b FROM profile UNION SELECT reach.a, two.b FROM reach JOIN two ON reach.b = two.a),
rooted AS (SELECT a AS piece, min(b) AS root FROM reach GROUP BY a)"""


def greedy_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, piece, root) of all pieces by the greedy links."""
    roots = components(greedy(spark, sf_dir).select(F.col("from_id").alias("u"), F.col("to_id").alias("v")))
    return profiles(spark, sf_dir).select("video_id", "piece").join(roots.withColumnRenamed("node", "piece"), "piece", "left").select("video_id", "piece", F.coalesce("root", "piece").alias("root"))


@query(f"WITH RECURSIVE {V1_ROOT_SQL} SELECT video_id, piece, root FROM rooted JOIN profile USING (piece)")
def greedy_clusters(spark, sf_dir):
    """Connected components of the greedy links."""
    return greedy_roots(spark, sf_dir)


@query()
def overlap_split(spark, sf_dir):
    """Greedy clusters split where members overlap in time (first fit, no SQL: tested against a loop)."""
    p = profiles(spark, sf_dir).select("video_id", "piece", "t0", "t1")
    return split_clusters(p, cut(greedy(spark, sf_dir))).select("video_id", "cluster", "part", "piece")


# ---------------------------------------------------------------- both variants side by side

VARIANTS = ("v1_greedy", "v2_graph")


def variant_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variant, video_id, piece, cluster, part): the clusters of both variants over one table of profiles, written.

    Nodes are numbered by piece and variant, so one run of components serves both; clusters are split where members
    overlap.
    """
    p = cut(profiles(spark, sf_dir))
    flag = F.when(F.col("variant") == VARIANTS[1], 1).otherwise(0)
    named = lambda links, name: links.select(F.lit(name).alias("variant"), "from_id", "to_id")
    links = cut(named(greedy(spark, sf_dir, p), VARIANTS[0]).unionByName(named(decided(spark, sf_dir, p=p).filter("accepted"), VARIANTS[1])))
    roots = components(links.select((F.col("from_id") * 2 + flag).alias("u"), (F.col("to_id") * 2 + flag).alias("v")))
    every = p.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in VARIANTS]))).withColumn("node", F.col("piece") * 2 + flag)
    d = cut(every.join(roots, "node", "left").select("variant", "video_id", "piece", F.col("t0").alias("start"), F.col("t1").alias("end"), F.coalesce("root", "node").alias("cluster"), F.col("piece").alias("id")))
    several = d.groupBy("cluster").count().filter("count > 1").select("cluster")
    alone = d.join(several, "cluster", "left_anti").withColumn("part", F.lit(0).cast("long"))
    split = matching.first_fit(d.join(several, "cluster", "left_semi").select(*d.columns), "cluster")
    return cut(alone.unionByName(split).select("variant", "video_id", "piece", "cluster", "part"))
