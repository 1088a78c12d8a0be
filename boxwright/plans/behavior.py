"""Events made of chunks of detections, their quality, and the merging of neighbouring events.

One builder makes events of any chunking: hints from the peak box, tier with downgrades, bounds padded and snapped to
frames, quality. Chunks come from presence segments, behaviour of a track, or behaviour of an identity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import scalars as s
from ..operators import islands as isl
from ..sources.shared import cut
from ..sources.tracked import FPS, HEIGHT, INTERVAL, TRACKED_SQL, WIDTH, tracked
from .identity import PIECES_SQL, V1_ROOT_SQL, greedy_roots, pieces, variant_members
from .registry import BOX, ORDER, mean_conf, query, r4

PRESENCE_GAP = 3.0
PAD = 2 * INTERVAL / FPS
#: Parameters are clamped to these ranges (fixed values).
BEHAVIOR_RANGE, MERGE_RANGE = (5.0, 8.0), (2.5, 3.0)


def clamped(value: float, bounds: tuple[float, float]) -> float:
    return max(bounds[0], min(bounds[1], value))


# ---------------------------------------------------------------- the event builder

def event_sql(rows: str, keys: str, name: str = "ev") -> str:
    """CTEs that make events (name) of the rows of a CTE, one for each value of keys."""
    return f"""{name}_r AS (SELECT *, t - lag(t) OVER (PARTITION BY {keys} ORDER BY frame, event_id) AS g FROM {rows}),
{name}_a AS (SELECT {keys}, any_value(video_id) AS video_id, max(frame) AS lf, count(*) AS n, min(t) AS t0, max(t) AS t1, max(conf) AS peak, min(conf) AS least_conf, sum(CAST(round(conf * 1000000) AS BIGINT)) / 1000000.0 / count(*) AS mean, max(g) AS g_max, avg(g) AS g_avg,
    {", ".join(f"arg_max({c}, (conf, -frame, -event_id)) AS p{c}" for c in BOX)}, {", ".join(f"arg_min({c}, (frame, event_id)) AS a{c}, arg_max({c}, (frame, event_id)) AS z{c}" for c in BOX)},
    max(CASE WHEN (x1 <= 2 OR y1 <= 12 OR x2 >= {WIDTH - 2} OR y2 >= {HEIGHT - 2}) AND (x2 - x1) * (y2 - y1) / {WIDTH * HEIGHT}.0 > 0.03 THEN 1 ELSE 0 END) AS edge_large FROM {name}_r GROUP BY {keys}),
{name}_f AS (SELECT * EXCLUDE (lf), least(vl, CAST(round(greatest(0.0, t0 - {PAD}) * {FPS}) AS BIGINT)) AS start_frame, least(vl, CAST(round(least(t1 + {PAD}, vl / {FPS}) * {FPS}) AS BIGINT)) AS end_frame,
    (py1 + py2) / 2 / {HEIGHT} > 0.60 AS low, (px1 <= 5 OR py1 <= 5 OR px2 >= {WIDTH - 5} OR py2 >= {HEIGHT - 5}) AND peak < 0.85 AS edge, (px2 - px1) / (py2 - py1) AS aspect FROM (SELECT *, max(lf) OVER (PARTITION BY video_id) AS vl FROM {name}_a)),
{name}_h AS (SELECT *, start_frame / {FPS} AS start_time, end_frame / {FPS} AS end_time, list_filter([CASE WHEN low THEN 'workzone_low' END, CASE WHEN edge THEN 'edge_clip' END, CASE WHEN aspect < 0.45 OR aspect > 2.0 THEN 'aspect_ratio' END], lambda h: h IS NOT NULL) AS hints FROM {name}_f),
{name} AS (SELECT *, CASE WHEN peak >= 0.85 AND len(hints) = 0 THEN 'auto' WHEN peak >= 0.75 THEN 'review' ELSE 'low_conf' END AS tier, end_frame - start_frame + 1 AS cov FROM {name}_h)"""


def make_events(d: DataFrame, keys: list[str]) -> DataFrame:
    """One event for each value of keys of detections d, all those of their videos; trajectories stay with d.

    Bounds end with the video, whose last frame (vl) is that of its last detection.
    """
    key, box = F.struct("frame", "event_id"), F.struct(*BOX)
    first_peak = F.struct(F.col("conf"), -F.col("frame"), -F.col("event_id"))
    large = ((F.col("x1") <= 2) | (F.col("y1") <= 12) | (F.col("x2") >= WIDTH - 2) | (F.col("y2") >= HEIGHT - 2)) & (g.area(g.box()) / float(WIDTH * HEIGHT) > 0.03)
    d = d.withColumn("g", F.col("t") - F.lag("t").over(Window.partitionBy(*keys).orderBy(*ORDER))).withColumn("edge_large", large.cast("int"))
    e = d.groupBy(*keys).agg(
        F.first("video_id").alias("video_id"), F.max("frame").alias("lf"), F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.max("conf").alias("peak"), F.min("conf").alias("least_conf"), mean_conf().alias("mean"), F.max("g").alias("g_max"), F.avg("g").alias("g_avg"),
        F.max_by(box, first_peak).alias("p"), F.min_by(box, key).alias("a"), F.max_by(box, key).alias("z"), F.max("edge_large").alias("edge_large"),
    )
    e = e.withColumn("vl", F.max("lf").over(Window.partitionBy("video_id"))).drop("lf")
    snap = lambda t: F.least(F.col("vl"), F.rint(t * FPS).cast("long"))
    e = e.withColumn("start_frame", snap(F.greatest(F.lit(0.0), F.col("t0") - PAD))).withColumn("end_frame", snap(F.least(F.col("t1") + PAD, F.col("vl") / FPS)))
    e = e.select("*", *[F.col(f"{x}.{c}").alias(f"{x}{c}") for x in "paz" for c in BOX]).drop("p", "a", "z")
    edge = ((F.col("px1") <= 5) | (F.col("py1") <= 5) | (F.col("px2") >= WIDTH - 5) | (F.col("py2") >= HEIGHT - 5)) & (F.col("peak") < 0.85)
    aspect = (F.col("px2") - F.col("px1")) / (F.col("py2") - F.col("py1"))
    hints = F.array_compact(F.array(F.when((F.col("py1") + F.col("py2")) / 2 / HEIGHT > 0.60, "workzone_low"), F.when(edge, "edge_clip"), F.when((aspect < 0.45) | (aspect > 2.0), "aspect_ratio")))
    e = e.withColumn("hints", hints).withColumn("start_time", F.col("start_frame") / FPS).withColumn("end_time", F.col("end_frame") / FPS)
    tier = F.when((F.col("peak") >= 0.85) & (F.size("hints") == 0), "auto").when(F.col("peak") >= 0.75, "review").otherwise("low_conf")
    return e.withColumn("tier", tier).withColumn("cov", F.col("end_frame") - F.col("start_frame") + 1)


STATUS_SQL = "CASE tier WHEN 'auto' THEN 'confirmed_face' WHEN 'review' THEN 'pending' ELSE 'logged_only' END"


def status():
    return F.when(F.col("tier") == "auto", "confirmed_face").when(F.col("tier") == "review", "pending").otherwise("logged_only")


def timecode_sql(t: str) -> str:
    ms = f"CAST(floor({t} * 1000 + 0.000001) AS BIGINT)"
    return f"printf('%02d:%02d:%02d.%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


def timecode(t):
    return s.timecode(t + 1e-9)


# ---------------------------------------------------------------- quality of events

QUALITY_SQL = """CASE WHEN (n <= 2 AND dur >= 3) OR (n <= 3 AND dur >= 8) OR max_gap >= 10 OR interp >= 0.9 THEN 'LOW' WHEN (n <= 4 AND dur >= 5) OR max_gap >= 5 OR interp >= 0.7 THEN 'MEDIUM' ELSE 'HIGH' END"""


def quality_sql(events: str, name: str = "ql") -> str:
    return f"""{name}_0 AS (SELECT *, round(end_time - start_time, 3) AS dur, CASE WHEN n >= 2 THEN round(g_max, 3) ELSE round(end_time - start_time, 3) END AS max_gap, CASE WHEN n >= 2 THEN round(g_avg, 3) ELSE round(end_time - start_time, 3) END AS avg_gap,
    round(greatest(greatest(0.0, t0 - start_time), coalesce(g_max, 0.0), greatest(0.0, end_time - t1)), 3) AS longest, CASE WHEN cov > 0 THEN round(greatest(0.0, (cov - n) / CAST(cov AS DOUBLE)), 4) ELSE 0.0 END AS interp FROM {events}),
{name} AS (SELECT *, {QUALITY_SQL} AS quality FROM {name}_0)"""


def scored(e: DataFrame) -> DataFrame:
    """Events with dur, max_gap, avg_gap, longest (uncovered stretch, bounds included), interp and quality."""
    dur = r4(F.col("end_time") - F.col("start_time"), 3)
    many = F.col("n") >= 2
    e = e.withColumn("dur", dur).withColumn("max_gap", F.when(many, r4(F.col("g_max"), 3)).otherwise(dur)).withColumn("avg_gap", F.when(many, r4(F.col("g_avg"), 3)).otherwise(dur))
    e = e.withColumn("longest", r4(F.greatest(F.lit(0.0), F.col("t0") - F.col("start_time"), F.coalesce("g_max", F.lit(0.0)), F.col("end_time") - F.col("t1")), 3))
    e = e.withColumn("interp", F.when(F.col("cov") > 0, r4(F.greatest(F.lit(0.0), (F.col("cov") - F.col("n")) / F.col("cov")))).otherwise(0.0))
    return e.withColumn("quality", s.quality_class(F.col("n"), F.col("dur"), F.col("max_gap"), F.col("interp")))


# ---------------------------------------------------------------- chunkings

SEG_SQL = f"seg3 AS (SELECT *, CAST(sum(CASE WHEN gap > {PRESENCE_GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY frame, event_id) AS BIGINT) AS seg FROM pieces)"
_LAG = "lag({0}) OVER (PARTITION BY {1} ORDER BY {2})"


def _jump(a: str, b: str, conf: bool) -> str:
    """SQL: the boxes a and b are not continuous (the limit relaxed by confidence, or fixed)."""
    return f"NOT {g.continuous_sql(a, b)}" if conf else f"NOT ({g.iou_sql(a, b)} >= 0.2 OR {g.distance_sql(a, b)} <= 1.5 * greatest({', '.join(f'sqrt(pow({x}x2-{x}x1, 2) + pow({x}y2-{x}y1, 2))' for x in (a, b))}))"


GAP = clamped(8.0, BEHAVIOR_RANGE)
TRACK_SQL = f"""{PIECES_SQL}, {SEG_SQL}, tl AS (SELECT *, lag(conf) OVER (PARTITION BY track_id ORDER BY frame, event_id) AS qconf FROM seg3),
tchunk AS (SELECT *, CAST(sum(CASE WHEN gap > {GAP} OR {_jump("q", "", True)} THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY frame, event_id) AS BIGINT) AS chunk FROM tl),
{event_sql("tchunk", "track_id, chunk", "te")}, {quality_sql("te", "tq")},
tnum AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY track_id, chunk) AS num FROM tq)"""


def track_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with the presence segment and behaviour chunk of their track."""
    d = isl.islands(tracked(spark, sf_dir), ["track_id"], ORDER, lambda d: d["t"] - d["prev_t"] > PRESENCE_GAP, ["t", "conf", *BOX])
    w = Window.partitionBy("track_id").orderBy(*ORDER)
    jump = ~g.continuous(g.box("prev_"), g.box(), F.col("prev_conf"), F.col("conf"))
    new = F.when(F.col("prev_t").isNull(), 0).when((F.col("t") - F.col("prev_t") > GAP) | jump, 1).otherwise(0)
    return d.withColumn("_new", new).withColumn("chunk", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def numbered(e: DataFrame, order: list[str]) -> DataFrame:
    """Events with num, dense in each video: a window over events, not detections."""
    return e.withColumn("num", F.row_number().over(Window.partitionBy("video_id").orderBy(*order)))


def track_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(scored(make_events(track_chunks(spark, sf_dir), ["track_id", "chunk"])), ["track_id", "chunk"])


EVENT_COLUMNS_SQL = f"""n AS detection_count, tier, {STATUS_SQL} AS review_status, array_to_string(hints, ',') AS rule_hints, start_frame, end_frame, round(start_time, 3) AS start_time, round(end_time, 3) AS end_time, {timecode_sql("start_time")} AS start_timecode, {timecode_sql("end_time")} AS end_timecode, round(peak, 4) AS peak_confidence, round(mean, 4) AS avg_confidence, quality"""


def event_columns():
    return [
        F.col("n").alias("detection_count"), "tier", status().alias("review_status"), F.array_join("hints", ",").alias("rule_hints"), "start_frame", "end_frame", r4(F.col("start_time"), 3).alias("start_time"), r4(F.col("end_time"), 3).alias("end_time"),
        timecode(F.col("start_time")).alias("start_timecode"), timecode(F.col("end_time")).alias("end_timecode"), r4(F.col("peak")).alias("peak_confidence"), r4(F.col("mean")).alias("avg_confidence"), "quality",
    ]


@query(f"""WITH {TRACK_SQL}, pres AS (SELECT track_id, chunk, count(DISTINCT seg) AS segments FROM tchunk GROUP BY 1, 2)
SELECT video_id, printf('bevt_%04d', num) AS event_id, track_id, chunk, {EVENT_COLUMNS_SQL}, segments AS presence_segments, segments > 1 AS cross_presence_span FROM tnum JOIN pres USING (track_id, chunk)""")
def track_behavior_events(spark, sf_dir):
    """Behaviour events of each track in full: bounds, tier, hints, quality, and the presence segments they span."""
    d = track_chunks(spark, sf_dir)
    segments = d.groupBy("track_id", "chunk").agg((F.max("seg") - F.min("seg") + 1).alias("presence_segments"))  # segments of a chunk are consecutive
    e = numbered(scored(make_events(d, ["track_id", "chunk"])), ["track_id", "chunk"]).join(segments, ["track_id", "chunk"])
    return e.select("video_id", F.format_string("bevt_%04d", "num").alias("event_id"), "track_id", "chunk", *event_columns(), "presence_segments", (F.col("presence_segments") > 1).alias("cross_presence_span"))


@query(f"""WITH {TRACK_SQL}, risk AS (SELECT *, list_filter([CASE WHEN (n <= 2 AND dur >= 3) OR (n <= 3 AND dur >= 8) THEN 'few detections (' || n || ')' END, CASE WHEN n <= 3 AND dur >= 8 THEN printf('long duration (%.1fs)', dur) END, CASE WHEN max_gap >= 10 THEN printf('detection gap (%.2fs)', max_gap) END, CASE WHEN interp >= 0.9 THEN printf('interpolated (%.4f)', interp) END], lambda h: h IS NOT NULL) AS risks FROM tnum)
SELECT video_id, track_id, chunk, quality, quality = 'LOW' AS suggest_reject, dur AS duration_sec, CASE WHEN dur > 0 THEN round(n / dur, 4) ELSE 0.0 END AS detection_density, max_gap AS max_detection_gap_sec, avg_gap AS avg_detection_gap_sec, longest AS longest_interpolation_gap_sec, interp AS interpolation_ratio, cov AS coverage_frames, CASE WHEN quality = 'LOW' THEN len(risks) ELSE 0 END AS risk_reasons, CASE WHEN quality = 'LOW' THEN coalesce(risks[1], '') ELSE '' END AS first_risk FROM risk""")
def event_quality_scores(spark, sf_dir):
    """Quality of behaviour events with the reasons why one is at risk."""
    e = track_events(spark, sf_dir)
    n, dur = F.col("n"), F.col("dur")
    risks = F.array_compact(F.array(
        F.when(((n <= 2) & (dur >= 3)) | ((n <= 3) & (dur >= 8)), F.format_string("few detections (%d)", n)), F.when((n <= 3) & (dur >= 8), F.format_string("long duration (%.1fs)", dur)),
        F.when(F.col("max_gap") >= 10, F.format_string("detection gap (%.2fs)", F.col("max_gap"))), F.when(F.col("interp") >= 0.9, F.format_string("interpolated (%.4f)", F.col("interp"))),
    ))
    low = F.col("quality") == "LOW"
    return e.withColumn("risks", risks).select(
        "video_id", "track_id", "chunk", "quality", low.alias("suggest_reject"), F.col("dur").alias("duration_sec"), F.when(dur > 0, r4(n / dur)).otherwise(0.0).alias("detection_density"), F.col("max_gap").alias("max_detection_gap_sec"), F.col("avg_gap").alias("avg_detection_gap_sec"),
        F.col("longest").alias("longest_interpolation_gap_sec"), F.col("interp").alias("interpolation_ratio"), F.col("cov").alias("coverage_frames"), F.when(low, F.size("risks").cast("long")).otherwise(0).alias("risk_reasons"), F.when(low, F.coalesce(F.get("risks", F.lit(0)), F.lit(""))).otherwise("").alias("first_risk"),
    )


@query(f"WITH {TRACK_SQL} SELECT video_id, q.quality, count(tnum.quality) AS events FROM (SELECT DISTINCT video_id FROM tnum) v CROSS JOIN (VALUES ('HIGH'), ('MEDIUM'), ('LOW')) q(quality) LEFT JOIN tnum USING (video_id, quality) GROUP BY 1, 2")
def quality_rollup(spark, sf_dir):
    """Events of each quality in each video, zeros filled in."""
    n = track_events(spark, sf_dir).groupBy("video_id").agg(*[F.count_if(F.col("quality") == q).alias(q) for q in ("HIGH", "MEDIUM", "LOW")])
    return n.unpivot("video_id", ["HIGH", "MEDIUM", "LOW"], "quality", "events")


IDENTITY_SQL = f"""{V1_ROOT_SQL}, {SEG_SQL}, idet AS (SELECT seg3.*, root FROM seg3 JOIN rooted USING (piece)),
il AS (SELECT * REPLACE (t - {_LAG.format("t", "root", "t, frame, event_id")} AS gap, {", ".join(f"{_LAG.format(c, 'root', 't, frame, event_id')} AS q{c}" for c in BOX)}), {_LAG.format("piece", "root", "t, frame, event_id")} AS ppiece FROM idet),
ichunk AS (SELECT *, CAST(sum(CASE WHEN gap > {GAP} OR {_jump("q", "", False)} OR piece <> ppiece THEN 1 ELSE 0 END) OVER (PARTITION BY root ORDER BY t, frame, event_id) AS BIGINT) AS chunk FROM il),
{event_sql("ichunk", "root, chunk", "ie")}, {quality_sql("ie", "iq")}, span AS (SELECT root, chunk, count(DISTINCT piece) AS pieces_in, min(piece) AS primary_piece, count(DISTINCT seg) AS segments FROM ichunk GROUP BY 1, 2), csize AS (SELECT root, count(*) AS members FROM rooted GROUP BY root),
inum AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY root, chunk) AS num FROM iq JOIN span USING (root, chunk) JOIN csize USING (root))"""


@query(f"""WITH RECURSIVE {IDENTITY_SQL} SELECT video_id, printf('bevt_%04d', num) AS event_id, root AS identity, primary_piece, {EVENT_COLUMNS_SQL}, pieces_in > 1 AS cross_track_merge, segments AS presence_segments, segments > 1 AS cross_presence_span, members AS identity_pieces FROM inum""")
def identity_behavior_events(spark, sf_dir):
    """Behaviour events of identities: pieces of a cluster in time order, cut at gaps, jumps and changes of piece.

    The presence segments of a chunk are counted by the number that each detection carries, with no interval join.
    """
    roots = greedy_roots(spark, sf_dir).select("piece", "root")
    d = isl.islands(pieces(spark, sf_dir), ["track_id"], ORDER, lambda d: d["t"] - d["prev_t"] > PRESENCE_GAP, [])
    d = d.drop("prev_t", *[f"prev_{c}" for c in BOX]).join(roots, "piece")
    fixed = lambda d: (g.iou(g.box("prev_"), g.box()) >= 0.2) | g.center_continuous(g.box("prev_"), g.box())
    d = isl.islands(d, ["root"], ["t", *ORDER], lambda d: (d["t"] - d["prev_t"] > GAP) | ~fixed(d) | (d["piece"] != d["prev_piece"]), ["t", "piece", *BOX], "chunk")
    span = d.groupBy("root", "chunk").agg(F.count_distinct("piece").alias("pieces_in"), F.min("piece").alias("primary_piece"), (F.max("seg") - F.min("seg") + 1).alias("presence_segments"))
    members = roots.groupBy("root").agg(F.count(F.lit(1)).alias("identity_pieces"))
    e = numbered(scored(make_events(d, ["root", "chunk"])), ["root", "chunk"]).join(span, ["root", "chunk"]).join(members, "root")
    return e.select("video_id", F.format_string("bevt_%04d", "num").alias("event_id"), F.col("root").alias("identity"), "primary_piece", *event_columns(), (F.col("pieces_in") > 1).alias("cross_track_merge"), "presence_segments", (F.col("presence_segments") > 1).alias("cross_presence_span"), "identity_pieces")


def stitched_events(spark: SparkSession, sf_dir: str, members: DataFrame) -> DataFrame:
    """Behaviour events of clusters' parts, members (variant, video_id, piece, cluster, part): one builder for all variants.

    Hints go on with the number of pieces of the part and whether the event spans presence segments; num counts in each
    variant of a video, part by part.
    """
    keys = ["variant", "cluster", "part"]
    d = isl.islands(pieces(spark, sf_dir), ["track_id"], ORDER, lambda d: d["t"] - d["prev_t"] > PRESENCE_GAP, [])
    d = d.drop("prev_t", "video_id", *[f"prev_{c}" for c in BOX], *(["part"] if "part" in d.columns else [])).join(members, "piece")
    fixed = lambda d: (g.iou(g.box("prev_"), g.box()) >= 0.2) | g.center_continuous(g.box("prev_"), g.box())
    d = cut(isl.islands(d, keys, ["t", *ORDER], lambda d: (d["t"] - d["prev_t"] > GAP) | ~fixed(d) | (d["piece"] != d["prev_piece"]), ["t", "piece", *BOX], "chunk"))
    span = d.groupBy(*keys, "chunk").agg(F.min("piece").alias("primary_piece"), F.count_distinct("seg").alias("presence_segments"))
    size = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("identity_pieces"))
    e = scored(make_events(d, [*keys, "chunk"])).join(span, [*keys, "chunk"]).join(size, keys)
    more = F.array_compact(F.array(F.when(F.col("identity_pieces") > 1, F.format_string("identity_stitch:%d", "identity_pieces")), F.when(F.col("presence_segments") > 1, F.lit("cross_presence_span"))))
    e = e.withColumn("hints", F.concat("hints", more))
    return e.withColumn("num", F.row_number().over(Window.partitionBy("variant", "video_id").orderBy("cluster", "part", "chunk")))


@query()
def stitched_behavior_events(spark, sf_dir):
    """Behaviour events of the clusters of both stitching variants (no SQL: tested against loops over the clusters)."""
    e = stitched_events(spark, sf_dir, variant_members(spark, sf_dir))
    return e.select("variant", "video_id", F.format_string("bevt_%04d", "num").alias("event_id"), "cluster", "part", "primary_piece", *event_columns(), "presence_segments", (F.col("presence_segments") > 1).alias("cross_presence_span"), "identity_pieces")


# ---------------------------------------------------------------- merging of presence events

SEG_EVENT_SQL = f"""{PIECES_SQL}, {SEG_SQL}, {event_sql("seg3", "track_id, seg", "se0")},
se AS (SELECT * REPLACE (CASE WHEN n = 1 THEN 'low_conf' ELSE tier END AS tier, CASE WHEN n = 1 THEN list_append(hints, 'singleton_fragment') ELSE hints END AS hints), row_number() OVER (PARTITION BY video_id ORDER BY track_id, seg) AS num FROM se0)"""


def presence_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of presence segments; single detections are low_conf."""
    d = isl.islands(tracked(spark, sf_dir), ["track_id"], ORDER, lambda d: d["t"] - d["prev_t"] > PRESENCE_GAP, ["t"])
    e = make_events(d, ["track_id", "seg"])
    one = F.col("n") == 1
    e = e.withColumn("tier", F.when(one, "low_conf").otherwise(F.col("tier"))).withColumn("hints", F.when(one, F.array_append("hints", F.lit("singleton_fragment"))).otherwise(F.col("hints")))
    return numbered(e, ["track_id", "seg"])


MERGE_GAP = clamped(3.0, MERGE_RANGE)


def _edge_sql(gap: str, limit: float) -> str:
    return f"""{SEG_EVENT_SQL}, eb AS (SELECT *, lag(num) OVER w AS from_num, round(greatest(0.0, start_time - lag(end_time) OVER w), 2) AS event_gap, round(greatest(0.0, t0 - lag(t1) OVER w), 3) AS det_gap, round(mean, 4) AS conf, lag(round(mean, 4)) OVER w AS qconf, {", ".join(f"a{c} AS {c}, lag(z{c}) OVER w AS q{c}" for c in BOX)} FROM se WINDOW w AS (PARTITION BY track_id ORDER BY start_time, start_frame, seg)),
ed AS (SELECT *, CASE WHEN {gap} > {limit} THEN 'gap_exceeded' WHEN {_jump("q", "", True)} THEN 'bbox_discontinuity' ELSE 'merged' END AS reason FROM eb),
mg AS (SELECT *, CAST(sum(CASE WHEN from_num IS NOT NULL AND reason <> 'merged' THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY start_time, start_frame, seg) AS BIGINT) AS grp FROM ed)"""


def merge_edges(spark: SparkSession, sf_dir: str, gap: str, limit: float) -> DataFrame:
    """Presence events with the verdict on the edge from their predecessor, and the group that they fall into."""
    w = Window.partitionBy("track_id").orderBy("start_time", "start_frame", "seg")
    d = presence_events(spark, sf_dir).withColumn("conf", r4(F.col("mean")))
    d = d.withColumn("from_num", F.lag("num").over(w)).withColumn("event_gap", r4(F.greatest(F.lit(0.0), F.col("start_time") - F.lag("end_time").over(w)), 2)).withColumn("det_gap", r4(F.greatest(F.lit(0.0), F.col("t0") - F.lag("t1").over(w)), 3)).withColumn("qconf", F.lag("conf").over(w))
    d = d.withColumns({f"q{c}": F.lag(f"z{c}").over(w) for c in BOX})
    first = F.col("from_num").isNull()  # greatest() skips nulls, so gaps of a first event are set to null
    d = d.withColumn("event_gap", F.when(~first, F.col("event_gap"))).withColumn("det_gap", F.when(~first, F.col("det_gap")))
    joined = g.continuous(g.box("q"), g.box("a"), F.col("qconf"), F.col("conf"))
    d = d.withColumn("reason", F.when(F.col(gap) > limit, "gap_exceeded").when(~joined, "bbox_discontinuity").otherwise("merged"))
    return d.withColumn("_new", F.when(~first & (F.col("reason") != "merged"), 1).otherwise(0)).withColumn("grp", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))


_EDGES_SQL = f"WITH {{0}} SELECT video_id, track_id, printf('evt_%04d', from_num) AS from_event_id, printf('evt_%04d', num) AS to_event_id, reason = 'merged' AS merged, event_gap AS event_gap_sec, det_gap AS detection_gap_sec, reason FROM ed WHERE from_num IS NOT NULL"


def _edge_rows(d: DataFrame) -> DataFrame:
    name = lambda c: F.format_string("evt_%04d", c)
    return d.filter("from_num is not null").select("video_id", "track_id", name("from_num").alias("from_event_id"), name("num").alias("to_event_id"), (F.col("reason") == "merged").alias("merged"), F.col("event_gap").alias("event_gap_sec"), F.col("det_gap").alias("detection_gap_sec"), "reason")


_MERGED_SQL = f"""WITH {{0}}, fin AS (SELECT video_id, track_id, grp, count(*) AS source_event_count, string_agg(printf('evt_%04d', num), ',' ORDER BY start_time, start_frame, seg) AS source_event_ids, min(start_time) AS start_time, max(end_time) AS end_time, min(start_frame) AS start_frame, max(end_frame) AS end_frame, CAST(sum(n) AS BIGINT) AS detection_count, max(peak) AS peak,
    max(CASE tier WHEN 'auto' THEN 0 WHEN 'review' THEN 1 ELSE 2 END) AS worst, list_distinct(flatten(list(hints ORDER BY start_time, start_frame, seg))) AS hints FROM mg GROUP BY 1, 2, 3)
SELECT video_id, printf('evt_%04d', row_number() OVER (PARTITION BY video_id ORDER BY track_id, grp)) AS event_id, track_id, source_event_count, source_event_ids, source_event_count > 1 AS behavior_merged, round(start_time, 3) AS start_time, round(end_time, 3) AS end_time, start_frame, end_frame, round(end_time - start_time, 3) AS duration_sec, detection_count, round(peak, 4) AS peak_confidence,
    ['auto', 'review', 'low_conf'][worst + 1] AS tier, len(hints) + CASE WHEN source_event_count > 1 THEN 1 ELSE 0 END AS hint_count, coalesce(array_to_string(list_sort(hints), ','), '') AS hint_set FROM fin"""


def _merged_rows(d: DataFrame) -> DataFrame:
    order = ("start_time", "start_frame", "seg")
    rank = F.when(F.col("tier") == "auto", 0).when(F.col("tier") == "review", 1).otherwise(2)
    in_order = F.array_sort(F.collect_list(F.struct(*order, "num", "hints")))
    m = d.groupBy("video_id", "track_id", "grp").agg(F.count(F.lit(1)).alias("source_event_count"), in_order.alias("m"), F.min("start_time").alias("a"), F.max("end_time").alias("z"), F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.sum("n").alias("detection_count"), F.max("peak").alias("peak"), F.max(rank).alias("worst"))
    m = m.withColumn("hints", F.array_distinct(F.flatten(F.transform("m", lambda x: x["hints"])))).withColumn("num", F.row_number().over(Window.partitionBy("video_id").orderBy("track_id", "grp")))
    many = F.col("source_event_count") > 1
    return m.select(
        "video_id", F.format_string("evt_%04d", "num").alias("event_id"), "track_id", "source_event_count", F.array_join(F.transform("m", lambda x: F.format_string("evt_%04d", x["num"])), ",").alias("source_event_ids"), many.alias("behavior_merged"), r4(F.col("a"), 3).alias("start_time"), r4(F.col("z"), 3).alias("end_time"),
        "start_frame", "end_frame", r4(F.col("z") - F.col("a"), 3).alias("duration_sec"), "detection_count", r4(F.col("peak")).alias("peak_confidence"), F.element_at(F.array(F.lit("auto"), F.lit("review"), F.lit("low_conf")), F.col("worst") + 1).alias("tier"),
        (F.size("hints") + F.when(many, 1).otherwise(0)).cast("long").alias("hint_count"), F.array_join(F.array_sort("hints"), ",").alias("hint_set"),
    )


@query(_EDGES_SQL.format(_edge_sql("event_gap", MERGE_GAP)))
def semantic_merge_edges(spark, sf_dir):
    """The verdict on every two consecutive presence events of a track."""
    return _edge_rows(merge_edges(spark, sf_dir, "event_gap", MERGE_GAP))


@query(_MERGED_SQL.format(_edge_sql("event_gap", MERGE_GAP)))
def merge_presence_events(spark, sf_dir):
    """Presence events at most MERGE_GAP apart, by padded bounds, with continuous boxes become one; worst tier, hints in order."""
    return _merged_rows(merge_edges(spark, sf_dir, "event_gap", MERGE_GAP))


@query(_MERGED_SQL.format(_edge_sql("det_gap", GAP)))
def fallback_merge_events(spark, sf_dir):
    """The same over the gap between detections, with the behaviour limit."""
    return _merged_rows(merge_edges(spark, sf_dir, "det_gap", GAP))


@query(f"""WITH {_edge_sql("event_gap", MERGE_GAP)}, e AS (SELECT * FROM ed WHERE from_num IS NOT NULL), groups AS (SELECT track_id, grp, count(*) AS c FROM mg GROUP BY 1, 2)
SELECT (SELECT count(*) FROM se) AS source_event_count, (SELECT count(*) FROM groups) AS merged_event_count, (SELECT count(*) FROM groups WHERE c > 1) AS merge_group_count, (SELECT count(*) FROM se) - (SELECT count(*) FROM groups) AS events_merged_away, round((SELECT count(*) FROM se) / greatest(1, (SELECT count(*) FROM groups)), 3) AS compression_ratio,
    count(*) AS edge_decision_total, count(*) FILTER (reason = 'gap_exceeded') AS gap_exceeded, count(*) FILTER (reason = 'bbox_discontinuity') AS bbox_discontinuity, count(*) FILTER (event_gap <= 2.5) AS gap_short, count(*) FILTER (event_gap > 2.5 AND event_gap <= 3.0) AS gap_middle, count(*) FILTER (event_gap > 3.0) AS gap_long FROM e""")
def merge_report(spark, sf_dir):
    """Counts of sources, results, edges, reasons and gaps, from one pass over the edges."""
    d = merge_edges(spark, sf_dir, "event_gap", MERGE_GAP)
    of = F.count_if
    edge, gap = F.col("from_num").isNotNull(), F.col("event_gap")
    by_group = d.groupBy("track_id", "grp").agg(F.count(F.lit(1)).alias("c"), of(edge).alias("e"), *[of(edge & (F.col("reason") == r)).alias(r) for r in ("gap_exceeded", "bbox_discontinuity")], of(gap <= 2.5).alias("s"), of((gap > 2.5) & (gap <= 3.0)).alias("m"), of(gap > 3.0).alias("l"))
    n, k = F.sum("c"), F.count(F.lit(1))
    return by_group.agg(n.alias("source_event_count"), k.alias("merged_event_count"), of(F.col("c") > 1).alias("merge_group_count"), (n - k).alias("events_merged_away"), r4(n / F.greatest(F.lit(1), k), 3).alias("compression_ratio"), F.sum("e").alias("edge_decision_total"), F.sum("gap_exceeded").alias("gap_exceeded"), F.sum("bbox_discontinuity").alias("bbox_discontinuity"), F.sum("s").alias("gap_short"), F.sum("m").alias("gap_middle"), F.sum("l").alias("gap_long"))


@query(f"""WITH {TRACK_SQL}, {event_sql("seg3", "track_id, seg", "se")}
SELECT t.video_id, t.track_id, t.chunk, count(*) AS segments, string_agg(CAST(s.seg AS VARCHAR), ',' ORDER BY s.seg) AS segment_ids FROM te t JOIN se s ON t.track_id = s.track_id AND s.end_time >= t.start_time AND s.start_time <= t.end_time GROUP BY 1, 2, 3""")
def segments_of_behavior(spark, sf_dir):
    """Segmentation events that a behaviour event of their track overlaps in time (closed intervals), by a bucketed join."""
    t = make_events(track_chunks(spark, sf_dir), ["track_id", "chunk"]).select("video_id", "track_id", "chunk", F.col("start_time").alias("a"), F.col("end_time").alias("z"))
    e = presence_events(spark, sf_dir).select("track_id", "seg", F.col("start_time").alias("b"), F.col("end_time").alias("y"))
    j = t.join(e, "track_id").filter("y >= a and b <= z")  # both sides are by track already
    return j.groupBy("video_id", "track_id", "chunk").agg(F.count(F.lit(1)).alias("segments"), F.array_join(F.transform(F.array_sort(F.collect_list("seg")), lambda x: x.cast("string")), ",").alias("segment_ids"))
