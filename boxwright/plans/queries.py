"""Named queries over the driver's tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import scalars as s
from ..operators import islands as isl
from ..operators import matching, nearest
from ..operators.components import components
from ..sources.shared import cut
from ..sources.tracked import FPS, HEIGHT, INTERVAL, TRACKED_SQL, WIDTH, decisions, table, tracked
from .registry import BOX, ORDER, QUERIES, SQL, mean_conf, part_id, query, r4  # noqa: F401

PRESENCE_GAP, BEHAVIOR_GAP, MERGE_GAP = 3.0, 8.0, 3.0


# ---------------------------------------------------------------- segmentation

SEGMENTS_SQL = f"""WITH {TRACKED_SQL},
lagged AS (SELECT *, t - lag(t) OVER w AS gap FROM tracked WINDOW w AS (PARTITION BY track_id ORDER BY frame, event_id)),
seg AS (SELECT *, CAST(sum(CASE WHEN gap > {PRESENCE_GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY frame, event_id) AS BIGINT) AS seg FROM lagged)"""
TIER_SQL = "CASE WHEN {0} >= 0.85 THEN 'auto' WHEN {0} >= 0.75 THEN 'review' ELSE 'low_conf' END"
PAD = 2 * INTERVAL


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isl.islands(tracked(spark, sf_dir), ["track_id"], ORDER, lambda d: d["t"] - d["prev_t"] > PRESENCE_GAP, ["t"])


@query(f"WITH {TRACKED_SQL} SELECT track_id, frame, event_id, round(t, 3) AS t, round(conf, 4) AS conf, x1, y1, x2, y2 FROM tracked WHERE conf >= 0.35 AND frame % {INTERVAL} = 0")
def stride_and_confidence_filter(spark, sf_dir):
    d = tracked(spark, sf_dir).filter((F.col("conf") >= 0.35) & (F.col("frame") % INTERVAL == 0))
    return d.select("track_id", "frame", "event_id", r4(F.col("t"), 3).alias("t"), r4(F.col("conf")).alias("conf"), "x1", "y1", "x2", "y2")


@query(f"""{SEGMENTS_SQL} SELECT track_id, seg, count(*) AS detection_count, round(min(t), 3) AS start_time, round(max(t), 3) AS end_time,
    min(frame) AS start_frame, max(frame) AS end_frame, round(max(conf), 4) AS peak_confidence, round(sum(CAST(round(conf * 1000000) AS BIGINT)) / 1000000.0 / count(*), 4) AS avg_confidence,
    CASE WHEN count(*) = 1 THEN 'low_conf' ELSE {TIER_SQL.format("max(conf)")} END AS tier,
    printf('pres_%04d_%02d', track_id, seg) AS presence_segment_id FROM seg GROUP BY track_id, seg""")
def presence_segments(spark, sf_dir):
    """Presence segments with tiers: one shuffle by track, then a partial aggregate in the same partitioning."""
    d = presence(spark, sf_dir).groupBy("track_id", "seg").agg(
        F.count(F.lit(1)).alias("detection_count"), r4(F.min("t"), 3).alias("start_time"), r4(F.max("t"), 3).alias("end_time"), F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.max("conf").alias("peak"), r4(mean_conf()).alias("avg_confidence")
    )
    tier = F.when(F.col("detection_count") == 1, "low_conf").otherwise(s.tier(F.col("peak")))
    return d.select("*", r4(F.col("peak")).alias("peak_confidence"), tier.alias("tier"), F.format_string("pres_%04d_%02d", "track_id", "seg").alias("presence_segment_id")).drop("peak")


@query(f"""{SEGMENTS_SQL}, gaps AS (SELECT track_id, event_id, frame, t, gap, lag(frame) OVER w AS prev_frame FROM seg WINDOW w AS (PARTITION BY track_id ORDER BY frame, event_id))
SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY frame, event_id) - 1 AS INTEGER) AS segment_index, round(gap, 3) AS gap_sec, round(t - gap, 3) AS start_time, round(t, 3) AS end_time, prev_frame AS start_frame, frame AS end_frame FROM gaps WHERE gap > {PRESENCE_GAP}""")
def absence_segments(spark, sf_dir):
    w = Window.partitionBy("track_id").orderBy(*ORDER)
    d = tracked(spark, sf_dir).withColumn("gap", F.col("t") - F.lag("t").over(w)).withColumn("start_frame", F.lag("frame").over(w)).filter(F.col("gap") > PRESENCE_GAP)
    return d.select("track_id", (F.row_number().over(w) - 1).alias("segment_index"), r4(F.col("gap"), 3).alias("gap_sec"), r4(F.col("t") - F.col("gap"), 3).alias("start_time"), r4(F.col("t"), 3).alias("end_time"), "start_frame", F.col("frame").alias("end_frame"))


@query(f"""WITH {TRACKED_SQL}, l AS (SELECT *, t - lag(t) OVER w AS gap FROM tracked WINDOW w AS (PARTITION BY track_id ORDER BY frame, event_id)),
c AS (SELECT *, CAST(sum(CASE WHEN gap >= 1.0 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY frame, event_id) AS BIGINT) AS chunk FROM l)
SELECT track_id, chunk, count(*) AS n, round(min(t), 3) AS start_time, round(max(t), 3) AS end_time, round(max(conf), 4) AS peak FROM c GROUP BY track_id, chunk""")
def legacy_events(spark, sf_dir):
    d = isl.islands(tracked(spark, sf_dir), ["track_id"], ORDER, lambda d: d["t"] - d["prev_t"] >= 1.0, ["t"], "chunk")
    return d.groupBy("track_id", "chunk").agg(F.count(F.lit(1)).alias("n"), r4(F.min("t"), 3).alias("start_time"), r4(F.max("t"), 3).alias("end_time"), r4(F.max("conf")).alias("peak"))


FACE_SQL = f"""{SEGMENTS_SQL}, peaks AS (SELECT *, row_number() OVER (PARTITION BY track_id, seg ORDER BY conf DESC, frame, event_id) AS rn FROM seg),
ev AS (SELECT track_id, seg, count(*) AS n, min(frame) AS f0, max(frame) AS f1, min(t) AS t0, max(t) AS t1, max(conf) AS peak, sum(CAST(round(conf * 1000000) AS BIGINT)) / 1000000.0 / count(*) AS mean,
    max(CASE WHEN rn = 1 THEN (y1 + y2) / 2 / {HEIGHT} END) AS cy, max(CASE WHEN rn = 1 THEN CASE WHEN x1 <= 5 OR y1 <= 5 OR x2 >= {WIDTH - 5} OR y2 >= {HEIGHT - 5} THEN 1 ELSE 0 END END) AS edge,
    max(CASE WHEN rn = 1 THEN (x2 - x1) / (y2 - y1) END) AS aspect FROM peaks GROUP BY track_id, seg),
hinted AS (SELECT *, concat_ws(',', CASE WHEN cy > 0.6 THEN 'workzone_low' END, CASE WHEN edge = 1 AND peak < 0.85 THEN 'edge_clip' END, CASE WHEN aspect < 0.45 OR aspect > 2.0 THEN 'aspect_ratio' END, CASE WHEN n = 1 THEN 'singleton_fragment' END) AS rule_hints FROM ev),
tiered AS (SELECT *, CASE WHEN n = 1 THEN 'low_conf' WHEN peak >= 0.85 AND rule_hints <> '' THEN 'review' ELSE {TIER_SQL.format("peak")} END AS tier,
    greatest(0, f0 - {PAD}) AS start_frame, f1 + {PAD} AS end_frame FROM hinted)"""


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by presence segment: hints from the peak box, tier with downgrades, padded bounds."""
    edge = (F.col("x1") <= 5) | (F.col("y1") <= 5) | (F.col("x2") >= WIDTH - 5) | (F.col("y2") >= HEIGHT - 5)
    d = presence(spark, sf_dir).withColumn("cy", (F.col("y1") + F.col("y2")) / 2 / HEIGHT).withColumn("edge", edge).withColumn("aspect", (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    first_peak = F.struct(F.col("conf"), -F.col("frame"), -F.col("event_id"))
    d = d.groupBy("track_id", "seg").agg(
        F.count(F.lit(1)).alias("n"), F.min("frame").alias("f0"), F.max("frame").alias("f1"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.max("conf").alias("peak"), mean_conf().alias("mean"), F.max_by(F.struct("cy", "edge", "aspect"), first_peak).alias("p"),
        F.max(F.when(F.col("t") - F.col("prev_t") <= PRESENCE_GAP, F.col("t") - F.col("prev_t"))).alias("inner_gap"),
    )
    hints = F.array_compact(F.array(
        F.when(F.col("p.cy") > 0.6, "workzone_low"), F.when(F.col("p.edge") & (F.col("peak") < 0.85), "edge_clip"),
        F.when((F.col("p.aspect") < 0.45) | (F.col("p.aspect") > 2.0), "aspect_ratio"), F.when(F.col("n") == 1, "singleton_fragment"),
    ))
    d = d.withColumn("rule_hints", hints)
    tier = F.when(F.col("n") == 1, "low_conf").when((F.col("peak") >= 0.85) & (F.size("rule_hints") > 0), "review").otherwise(s.tier(F.col("peak")))
    return d.withColumn("tier", tier).withColumn("start_frame", F.greatest(F.lit(0), F.col("f0") - PAD)).withColumn("end_frame", F.col("f1") + PAD)


@query(f"""{FACE_SQL} SELECT track_id, seg, n AS detection_count, tier, rule_hints, CASE tier WHEN 'auto' THEN 'confirmed_face' WHEN 'review' THEN 'pending' ELSE 'logged_only' END AS review_status,
    start_frame, end_frame, round(start_frame / {FPS}, 3) AS start_time, round(end_frame / {FPS}, 3) AS end_time,
    printf('%02d:%02d:%02d.%03d', CAST(floor(start_frame * 1000 / {FPS}) AS BIGINT) // 3600000, CAST(floor(start_frame * 1000 / {FPS}) AS BIGINT) // 60000 % 60, CAST(floor(start_frame * 1000 / {FPS}) AS BIGINT) // 1000 % 60, CAST(floor(start_frame * 1000 / {FPS}) AS BIGINT) % 1000) AS start_timecode,
    round(peak, 4) AS peak_confidence, round(mean, 4) AS avg_confidence FROM tiered""")
def face_events(spark, sf_dir):
    d = faces(spark, sf_dir)
    status = F.when(F.col("tier") == "auto", "confirmed_face").when(F.col("tier") == "review", "pending").otherwise("logged_only")
    ms = F.floor(F.col("start_frame") * 1000 / FPS)
    code = F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
    return d.select("track_id", "seg", F.col("n").alias("detection_count"), "tier", F.array_join("rule_hints", ",").alias("rule_hints"), status.alias("review_status"), "start_frame", "end_frame", r4(F.col("start_frame") / FPS, 3).alias("start_time"), r4(F.col("end_frame") / FPS, 3).alias("end_time"), code.alias("start_timecode"), r4(F.col("peak")).alias("peak_confidence"), r4(F.col("mean")).alias("avg_confidence"))


@query(f"""{FACE_SQL}, w AS (SELECT track_id, seg, max(gap) AS inner_gap FROM (SELECT track_id, seg, t - lag(t) OVER (PARTITION BY track_id, seg ORDER BY frame, event_id) AS gap FROM seg) GROUP BY 1, 2),
q AS (SELECT track_id, seg, n, (end_frame - start_frame) / {FPS} AS dur, end_frame - start_frame + 1 AS cov, CASE WHEN n <= 1 THEN (end_frame - start_frame) / {FPS} ELSE inner_gap END AS max_gap FROM tiered JOIN w USING (track_id, seg)),
i AS (SELECT *, greatest(0.0, (cov - n) / CAST(cov AS DOUBLE)) AS interp FROM q)
SELECT track_id, seg, round(dur, 3) AS duration_sec, round(max_gap, 3) AS max_gap_sec, round(interp, 4) AS interpolation_ratio, round(n / dur, 4) AS density,
    CASE WHEN (n <= 2 AND dur >= 3) OR (n <= 3 AND dur >= 8) OR max_gap >= 10 OR interp >= 0.9 THEN 'LOW' WHEN (n <= 4 AND dur >= 5) OR max_gap >= 5 OR interp >= 0.7 THEN 'MEDIUM' ELSE 'HIGH' END AS quality FROM i""")
def event_quality(spark, sf_dir):
    d = faces(spark, sf_dir).withColumn("dur", (F.col("end_frame") - F.col("start_frame")) / FPS).withColumn("cov", F.col("end_frame") - F.col("start_frame") + 1)
    d = d.withColumn("max_gap", F.when(F.col("n") <= 1, F.col("dur")).otherwise(F.col("inner_gap"))).withColumn("interp", F.greatest(F.lit(0.0), (F.col("cov") - F.col("n")) / F.col("cov")))
    quality = s.quality_class(F.col("n"), F.col("dur"), F.col("max_gap"), F.col("interp"))
    return d.select("track_id", "seg", r4(F.col("dur"), 3).alias("duration_sec"), r4(F.col("max_gap"), 3).alias("max_gap_sec"), r4(F.col("interp")).alias("interpolation_ratio"), r4(F.col("n") / F.col("dur")).alias("density"), quality.alias("quality"))


# ---------------------------------------------------------------- statistics

@query(f"""WITH {TRACKED_SQL}, p AS (SELECT track_id, count(*) AS n, max(t) - min(t) AS dur FROM tracked GROUP BY 1)
SELECT count(*) AS track_count, round(avg(n), 4) AS avg_detections, round(avg(dur), 4) AS avg_duration, arg_max(track_id, (dur, -track_id)) AS longest_track, arg_min(track_id, (dur, track_id)) AS shortest_track FROM p""")
def track_stats(spark, sf_dir):
    p = tracked(spark, sf_dir).groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t")).alias("dur"))
    return p.agg(F.count(F.lit(1)).alias("track_count"), r4(F.avg("n")).alias("avg_detections"), r4(F.avg("dur")).alias("avg_duration"), F.max_by("track_id", F.struct("dur", -F.col("track_id"))).alias("longest_track"), F.min_by("track_id", F.struct("dur", "track_id")).alias("shortest_track"))


@query(f"""WITH {TRACKED_SQL} SELECT count(*) AS total_detections, count(DISTINCT frame) AS sampled_frames, round(sum(CAST(round(conf * 1000000) AS BIGINT)) / 1000000.0 / count(*), 4) AS avg_confidence, round(count(*) / ((max(t) - min(t)) / 60), 4) AS detections_per_minute, round(max(t), 3) AS duration_sec FROM tracked""")
def detection_summary(spark, sf_dir):
    d = tracked(spark, sf_dir)
    return d.agg(F.count(F.lit(1)).alias("total_detections"), F.count_distinct("frame").alias("sampled_frames"), r4(mean_conf()).alias("avg_confidence"), r4(F.count(F.lit(1)) / ((F.max("t") - F.min("t")) / 60)).alias("detections_per_minute"), r4(F.max("t"), 3).alias("duration_sec"))


@query(f"""WITH {TRACKED_SQL}, b AS (SELECT least(19, greatest(7, CAST(floor(round(conf * 1000) / 50) AS BIGINT))) AS bin, count(*) AS n FROM tracked GROUP BY 1)
SELECT r.range AS bin, printf('%.2f-%.2f', r.range * 0.05, r.range * 0.05 + 0.05) AS label, coalesce(n, 0) AS n FROM range(7, 20) r LEFT JOIN b ON b.bin = r.range""")
def confidence_histogram(spark, sf_dir):
    """Zero-filled bins of 0.05 from 0.35; strays below and 1.0 go to the outer bins."""
    bin_ = F.least(F.lit(19), F.greatest(F.lit(7), F.floor(F.round(F.col("conf") * 1000) / 50)))
    n = tracked(spark, sf_dir).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = spark.range(7, 20).select(F.col("id").alias("bin"), F.format_string("%.2f-%.2f", F.col("id") * 0.05, F.col("id") * 0.05 + 0.05).alias("label"))
    return bins.join(n, "bin", "left").fillna(0, ["n"])


@query(f"""WITH {TRACKED_SQL} SELECT round(avg(CASE WHEN conf < 0.45 THEN 1.0 ELSE 0.0 END), 4) AS very_low, round(avg(CASE WHEN conf >= 0.45 AND conf < 0.5 THEN 1.0 ELSE 0.0 END), 4) AS low, round(avg(CASE WHEN conf >= 0.5 AND conf < 0.75 THEN 1.0 ELSE 0.0 END), 4) AS middle, round(avg(CASE WHEN conf >= 0.75 THEN 1.0 ELSE 0.0 END), 4) AS high FROM tracked""")
def histogram_ratios(spark, sf_dir):
    c = F.col("conf")
    share = lambda x: r4(F.avg(F.when(x, 1.0).otherwise(0.0)))
    return tracked(spark, sf_dir).agg(share(c < 0.45).alias("very_low"), share((c >= 0.45) & (c < 0.5)).alias("low"), share((c >= 0.5) & (c < 0.75)).alias("middle"), share(c >= 0.75).alias("high"))


# ---------------------------------------------------------------- behavior

BEHAVIOR_SQL = f"""WITH {TRACKED_SQL}, l AS (SELECT *, lag(t) OVER w AS pt, {", ".join(f"lag({c}) OVER w AS p{c}" for c in ("x1", "y1", "x2", "y2", "conf", "frame"))} FROM tracked WINDOW w AS (PARTITION BY track_id ORDER BY frame, event_id)),
edges AS (SELECT *, t - pt AS gap, {g.continuous_sql("p", "")} AS joined FROM l),
b AS (SELECT *, CAST(sum(CASE WHEN gap > {BEHAVIOR_GAP} OR NOT joined THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY frame, event_id) AS BIGINT) AS chunk FROM edges)"""


def _continuity(d: DataFrame):
    return g.continuous(g.box("prev_"), g.box(), F.col("prev_conf"), F.col("conf"))


@query(f"""{BEHAVIOR_SQL} SELECT track_id, chunk, count(*) AS n, round(min(t), 3) AS start_time, round(max(t), 3) AS end_time, round(max(conf), 4) AS peak, {TIER_SQL.format("max(conf)")} AS tier FROM b GROUP BY track_id, chunk""")
def behavior_chunks(spark, sf_dir):
    """Chunks of a track: cut at gaps over 8 s and where the box jumps."""
    d = isl.islands(tracked(spark, sf_dir), ["track_id"], ORDER, lambda d: (d["t"] - d["prev_t"] > BEHAVIOR_GAP) | ~_continuity(d), [*BOX, "t", "conf"], "chunk")
    return d.groupBy("track_id", "chunk").agg(F.count(F.lit(1)).alias("n"), r4(F.min("t"), 3).alias("start_time"), r4(F.max("t"), 3).alias("end_time"), F.max("conf").alias("p")).select("track_id", "chunk", "n", "start_time", "end_time", r4(F.col("p")).alias("peak"), s.tier(F.col("p")).alias("tier"))


@query(f"""{BEHAVIOR_SQL} SELECT CASE WHEN gap <= 2.5 THEN '<=2.5' WHEN gap <= 3.0 THEN '2.5-3.0' ELSE '>3.0' END AS gap_bucket, CASE WHEN gap > {BEHAVIOR_GAP} THEN 'gap' WHEN NOT joined THEN 'box' ELSE 'merged' END AS reason, count(*) AS n FROM edges WHERE gap IS NOT NULL GROUP BY 1, 2""")
def edge_decisions(spark, sf_dir):
    w = Window.partitionBy("track_id").orderBy(*ORDER)
    d = tracked(spark, sf_dir)
    for c in (*BOX, "t", "conf"):
        d = d.withColumn(f"prev_{c}", F.lag(c).over(w))
    gap = F.col("t") - F.col("prev_t")
    bucket = F.when(gap <= 2.5, "<=2.5").when(gap <= 3.0, "2.5-3.0").otherwise(">3.0")
    reason = F.when(gap > BEHAVIOR_GAP, "gap").when(~_continuity(d), "box").otherwise("merged")
    return d.filter(gap.isNotNull()).groupBy(bucket.alias("gap_bucket"), reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- timeline

SPLIT_FRAMES, FILL = 4 * INTERVAL, 3 * INTERVAL
SPLIT_RULE = f"pframe IS NOT NULL AND (frame - pframe > {SPLIT_FRAMES} OR ({g.iou_sql('p', '')} < 0.03 AND {g.center_ratio_sql('p', '')} > 1.10) OR {g.area_ratio_sql('p', '')} > 4.0)"
SPLIT_SQL = BEHAVIOR_SQL + f""", sp AS (SELECT *, CAST(sum(CASE WHEN {SPLIT_RULE} THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY frame, event_id) AS BIGINT) AS part FROM l),
nx AS (SELECT *, lead(frame) OVER w AS nf, {", ".join(f"lead({c}) OVER w AS n{c}" for c in (*BOX, "conf"))} FROM sp WINDOW w AS (PARTITION BY track_id, part ORDER BY frame, event_id)),
dense AS (
    SELECT track_id, part, frame, x1, y1, x2, y2, conf, 'detection' AS kind FROM nx
    UNION ALL SELECT track_id, part, f AS frame, {", ".join(f"{c} + (n{c} - {c}) * ((f - frame) / CAST(nf - frame AS DOUBLE)) AS {c}" for c in (*BOX, "conf"))}, 'between' FROM (SELECT *, unnest(range(frame + 1, nf)) AS f FROM nx WHERE nf - frame > 1 AND nf - frame <= {FILL})
    UNION ALL SELECT track_id, part, f, x1, y1, x2, y2, conf, 'hold' FROM (SELECT *, unnest(range(frame + 1, frame + {PAD} + 1)) AS f FROM nx WHERE nf IS NULL)
    UNION ALL SELECT track_id, part, f, x1, y1, x2, y2, conf, 'hold' FROM (SELECT *, unnest(range(greatest(0, frame - {PAD}), frame)) AS f FROM (SELECT *, row_number() OVER (PARTITION BY track_id, part ORDER BY frame, event_id) AS rn FROM nx) WHERE rn = 1))"""


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = g.box("prev_"), g.box()
    rule = lambda d: (d["frame"] - d["prev_frame"] > SPLIT_FRAMES) | ((g.iou(a, b) < 0.03) & (g.center_ratio(a, b) > 1.10)) | (g.area_ratio(a, b) > 4.0)
    return isl.islands(tracked(spark, sf_dir), ["track_id"], ORDER, rule, [*BOX, "frame"], "part")


def stands(d: DataFrame) -> DataFrame:
    """Detections with the frames they stand for: themselves, the way to a near next one, and holds at both ends."""
    w = Window.partitionBy("track_id", "part").orderBy(*ORDER)
    n = d.withColumn("nf", F.lead("frame").over(w)).withColumn("rn", F.row_number().over(w)).withColumns({f"n{c}": F.lead(c).over(w) for c in (*BOX, "conf")})
    frames = F.concat(
        F.array(F.struct(F.lit("detection").alias("kind"), F.col("frame").alias("f"))),
        F.when((F.col("nf") - F.col("frame") > 1) & (F.col("nf") - F.col("frame") <= FILL), F.transform(F.sequence(F.col("frame") + 1, F.col("nf") - 1), lambda f: F.struct(F.lit("between").alias("kind"), f.alias("f")))).otherwise(F.array()),
        F.when(F.col("nf").isNull(), F.transform(F.sequence(F.col("frame") + 1, F.col("frame") + PAD), lambda f: F.struct(F.lit("hold").alias("kind"), f.alias("f")))).otherwise(F.array()),
        F.when((F.col("rn") == 1) & (F.col("frame") > 0), F.transform(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("frame") - PAD), F.col("frame") - 1), lambda f: F.struct(F.lit("hold").alias("kind"), f.alias("f")))).otherwise(F.array()),
    )
    return n.withColumn("stands", frames)


def densify(d: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each frame that a detection stands for (a bag: frames may repeat), with the columns of keep."""
    vals = [*BOX, "conf"]
    x = stands(d).select("track_id", "part", *keep, "frame", "nf", *vals, *[f"n{c}" for c in vals], F.explode("stands").alias("e"))
    share = (F.col("e.f") - F.col("frame")) / (F.col("nf") - F.col("frame"))
    return x.select("track_id", "part", *keep, F.col("e.f").alias("frame"), *[F.when(F.col("e.kind") == "between", F.col(c) + (F.col(f"n{c}") - F.col(c)) * share).otherwise(F.col(c)).alias(c) for c in vals], F.col("e.kind").alias("kind"))


@query(f"""{SPLIT_SQL} SELECT track_id, part, count(*) AS n, min(frame) AS f0, max(frame) AS f1 FROM sp GROUP BY 1, 2""")
def split_trajectories(spark, sf_dir):
    return split(spark, sf_dir).groupBy("track_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("f0"), F.max("frame").alias("f1"))


@query(f"""{SPLIT_SQL} SELECT track_id, part, frame, kind, {", ".join(f"round({c}, 1) AS {c}" for c in BOX)}, round(conf, 4) AS conf FROM dense""")
def interpolated_entries(spark, sf_dir):
    d = densify(split(spark, sf_dir))
    return d.select("track_id", "part", "frame", "kind", *[r4(F.col(c), 1).alias(c) for c in BOX], r4(F.col("conf")).alias("conf"))


PROPOSAL_SQL = SPLIT_SQL + f""", prop AS (SELECT track_id, part, min(frame) AS start_frame, max(frame) AS end_frame, count(DISTINCT frame) AS frame_count, sum(CASE WHEN kind = 'detection' THEN 1 ELSE 0 END) AS detection_count, sum(CAST(round(conf * 1000000) AS BIGINT)) / 1000000.0 / count(*) AS mean, max(conf) AS peak FROM dense GROUP BY 1, 2)"""


def proposals_of(d: DataFrame) -> DataFrame:
    """Proposals of split detections: dense frames are counted and their confidences summed before they are written out."""
    share = lambda x: (x["f"] - F.col("frame")) / (F.col("nf") - F.col("frame"))
    conf = lambda x: F.when(x["kind"] == "between", F.col("conf") + (F.col("nconf") - F.col("conf")) * share(x)).otherwise(F.col("conf"))
    total = F.aggregate("stands", F.lit(0).cast("long"), lambda acc, x: acc + F.round(conf(x) * 1_000_000).cast("long"))
    own = F.size(F.filter("stands", lambda x: x["kind"] != "detection")) + F.when(F.coalesce(F.col("nf") != F.col("frame"), F.lit(True)), 1).otherwise(0)
    n = stands(d).withColumn("total", total).withColumn("own", own)
    return n.groupBy("track_id", "part").agg(F.greatest(F.lit(0).cast("long"), F.min("frame") - PAD).alias("start_frame"), (F.max("frame") + PAD).alias("end_frame"), F.sum("own").alias("frame_count"), F.count(F.lit(1)).alias("detection_count"), (F.sum("total") / F.lit(1_000_000.0) / F.sum(F.size("stands"))).alias("mean"), F.max("conf").alias("peak"))


@query(f"""{PROPOSAL_SQL} SELECT track_id, part, start_frame, end_frame, frame_count, CAST(detection_count AS BIGINT) AS detection_count, round((end_frame - start_frame) / {FPS}, 3) AS duration_sec, round(mean, 4) AS avg_confidence, round(peak, 4) AS peak_confidence,
    CASE WHEN {TIER_SQL.format("peak")} = 'low_conf' AND NOT (peak >= 0.35 AND (end_frame - start_frame) / {FPS} <= 3.0) THEN 'suppressed' WHEN {TIER_SQL.format("peak")} = 'low_conf' AND peak < 0.70 THEN 'low_peak' ELSE 'keep' END AS review_reason FROM prop""")
def mask_proposals(spark, sf_dir):
    d = proposals_of(split(spark, sf_dir)).withColumn("dur", (F.col("end_frame") - F.col("start_frame")) / FPS)
    low = s.tier(F.col("peak")) == "low_conf"
    reason = F.when(low & ~((F.col("peak") >= 0.35) & (F.col("dur") <= 3.0)), "suppressed").when(low & (F.col("peak") < 0.70), "low_peak").otherwise("keep")
    return d.select("track_id", "part", "start_frame", "end_frame", "frame_count", "detection_count", r4(F.col("dur"), 3).alias("duration_sec"), r4(F.col("mean")).alias("avg_confidence"), r4(F.col("peak")).alias("peak_confidence"), reason.alias("review_reason"))


@query(f"""{PROPOSAL_SQL}, dec AS (SELECT doc_id AS proposal, CASE WHEN quality = 0 THEN 'rejected' WHEN toxic = 1 THEN 'first_half' ELSE 'accepted' END AS status FROM labels),
chosen AS (SELECT p.*, {TIER_SQL.format("peak")} AS tier, status, (start_frame + end_frame) // 2 AS mid FROM prop p LEFT JOIN dec ON dec.proposal = p.track_id)
SELECT frame, count(*) AS boxes, count(DISTINCT d.track_id) AS tracks FROM dense d JOIN chosen c ON d.track_id = c.track_id AND d.part = c.part
WHERE (tier = 'auto' AND coalesce(status, '') <> 'rejected') OR status = 'accepted' OR (status = 'first_half' AND frame <= mid) GROUP BY frame""")
def render_frames(spark, sf_dir):
    """Frames and boxes of the entries that decisions let through.

    A proposal's bounds and tier come from a window over its detections, so dense rows are neither shuffled nor joined.
    """
    w = Window.partitionBy("track_id", "part")
    mid = F.floor((F.greatest(F.lit(0).cast("long"), F.min("frame").over(w) - PAD) + F.max("frame").over(w) + PAD) / 2)
    d = split(spark, sf_dir).withColumn("tier", s.tier(F.max("conf").over(w))).withColumn("mid", mid)
    d = d.join(decisions(spark, sf_dir).withColumnRenamed("proposal", "track_id"), "track_id", "left")
    auto = (F.col("tier") == "auto") & (F.coalesce("status", F.lit("")) != "rejected")
    half = F.coalesce(F.col("status") == "first_half", F.lit(False))
    d = d.filter(auto | half | F.coalesce(F.col("status") == "accepted", F.lit(False)))
    ok = auto | (F.col("status") == "accepted") | (half & (F.col("frame") <= F.col("mid")))
    return densify(d, ("tier", "status", "mid")).filter(ok).groupBy("frame").agg(F.count(F.lit(1)).alias("boxes"), F.count_distinct("track_id").alias("tracks"))


# ---------------------------------------------------------------- review

@query(f"""{FACE_SQL}, d AS (SELECT t.*, CASE WHEN quality = 0 THEN 'rejected' WHEN quality = 1 THEN 'accepted' END AS status FROM tiered t LEFT JOIN labels ON doc_id = track_id)
SELECT count(*) AS total, count(CASE WHEN status = 'accepted' THEN 1 END) AS accepted, count(CASE WHEN status = 'rejected' THEN 1 END) AS rejected, count(CASE WHEN status IS NULL THEN 1 END) AS remaining, round(100.0 * count(status) / count(*), 1) AS reviewed_pct, round(avg(CASE WHEN status = 'accepted' THEN peak END), 4) AS avg_peak_accepted FROM d""")
def review_report(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("track_id"), F.when(F.col("quality") == 0, "rejected").otherwise("accepted").alias("status"))
    d = faces(spark, sf_dir).join(lab, "track_id", "left")
    n = F.count(F.lit(1))
    return d.agg(n.alias("total"), F.count_if(F.col("status") == "accepted").alias("accepted"), F.count_if(F.col("status") == "rejected").alias("rejected"), F.count_if(F.col("status").isNull()).alias("remaining"), r4(100.0 * F.count("status") / n, 1).alias("reviewed_pct"), r4(F.avg(F.when(F.col("status") == "accepted", F.col("peak")))).alias("avg_peak_accepted"))


@query(f"""{FACE_SQL} SELECT t.tier AS tier, count(CASE WHEN quality = 1 THEN 1 END) AS accepted, count(CASE WHEN quality = 0 THEN 1 END) AS rejected FROM tiered t LEFT JOIN labels ON doc_id = track_id GROUP BY t.tier""")
def quality_gate(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("track_id"), "quality")
    return faces(spark, sf_dir).join(lab, "track_id", "left").groupBy("tier").agg(F.count_if(F.col("quality") == 1).alias("accepted"), F.count_if(F.col("quality") == 0).alias("rejected"))


@query(f"""{FACE_SQL} SELECT tier, count(*) AS events, round(count(*) * 30.0 / 60, 2) AS review_minutes FROM tiered GROUP BY tier""")
def review_cost(spark, sf_dir):
    return faces(spark, sf_dir).groupBy("tier").agg(F.count(F.lit(1)).alias("events")).select("tier", "events", r4(F.col("events") * 30.0 / 60, 2).alias("review_minutes"))


@query(f"""{FACE_SQL} SELECT track_id, seg, tier, CASE WHEN tier = 'low_conf' AND contains(rule_hints, 'edge_clip') AND peak >= 0.45 AND (end_frame - start_frame) / {FPS} <= 2.5 THEN 'review' ELSE tier END AS promoted_tier FROM tiered""")
def low_conf_promotion(spark, sf_dir):
    ok = (F.col("tier") == "low_conf") & F.array_contains("rule_hints", "edge_clip") & (F.col("peak") >= 0.45) & ((F.col("end_frame") - F.col("start_frame")) / FPS <= 2.5)
    return faces(spark, sf_dir).select("track_id", "seg", "tier", F.when(ok, "review").otherwise(F.col("tier")).alias("promoted_tier"))


# ---------------------------------------------------------------- interval algebra

RUNS_SQL = f"""{FACE_SQL}, iv AS (SELECT CASE WHEN tier = 'low_conf' THEN 'low' ELSE 'main' END AS lane, start_frame, end_frame FROM tiered), tot AS (SELECT max(end_frame) + 1 AS total FROM iv),
io AS (SELECT *, max(end_frame) OVER (PARTITION BY lane ORDER BY start_frame, end_frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM iv)"""


def _merged_sql(gap: int, name: str = "mg", source: str = "io") -> str:
    return f"""{name} AS (SELECT lane, min(start_frame) AS start_frame, max(end_frame) AS end_frame FROM (SELECT *, sum(CASE WHEN start_frame - before - 1 <= {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY lane ORDER BY start_frame, end_frame ROWS UNBOUNDED PRECEDING) AS grp FROM {source}) GROUP BY lane, grp)"""


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faces(spark, sf_dir).select(F.when(F.col("tier") == "low_conf", "low").otherwise("main").alias("lane"), "start_frame", "end_frame")


@query(f"WITH {TRACKED_SQL}, d AS (SELECT DISTINCT track_id, frame FROM tracked), r AS (SELECT *, frame - row_number() OVER (PARTITION BY track_id ORDER BY frame) AS grp FROM d) SELECT track_id, min(frame) AS start_frame, max(frame) AS end_frame FROM r GROUP BY track_id, grp")
def frame_runs(spark, sf_dir):
    return isl.runs(tracked(spark, sf_dir), ["track_id"], "frame")


#: Frames of a bucket of coalesce_spread: the lanes are few, so their intervals are sorted in buckets of frames.
SPREAD = 600


def _whole_merged(spark, sf_dir):
    """Merged intervals of all events, with the number of frames of the video as total."""
    d = cut(_intervals(spark, sf_dir))
    total = d.agg((F.max("end_frame") + 1).alias("total"))
    return cut(isl.coalesce_spread(d, ["lane"], "start_frame", "end_frame", 31, SPREAD).crossJoin(F.broadcast(total)))


@query(f"{RUNS_SQL}, {_merged_sql(30)} SELECT * FROM mg")
def merged_intervals(spark, sf_dir):
    return _whole_merged(spark, sf_dir).drop("total")


@query(f"""{RUNS_SQL}, {_merged_sql(30)} SELECT lane, type, start_frame, end_frame FROM (
    SELECT lane, 'render' AS type, start_frame, end_frame FROM mg
    UNION ALL SELECT lane, 'copy', coalesce(lag(end_frame) OVER (PARTITION BY lane ORDER BY start_frame) + 1, 0), start_frame - 1 FROM mg
    UNION ALL SELECT lane, 'copy', max(end_frame) + 1, (SELECT total FROM tot) - 1 FROM mg GROUP BY lane) WHERE start_frame <= end_frame""")
def segment_plan(spark, sf_dir):
    return isl.complement(_whole_merged(spark, sf_dir), ["lane"], F.col("total"))


@query(f"""{RUNS_SQL}, {_merged_sql(30)} SELECT lane, start_frame, end_frame, (start_frame // 60) * 60 AS key_floor, least((SELECT total FROM tot), ((end_frame + 1 + 59) // 60) * 60) - 1 AS key_ceil FROM mg""")
def keyframe_snap(spark, sf_dir):
    """Each interval grown to the keyframes around it, one each 60 frames."""
    ceil = F.ceil((F.col("end_frame") + 1) / 60) * 60
    return _whole_merged(spark, sf_dir).select("lane", "start_frame", "end_frame", (F.floor(F.col("start_frame") / 60) * 60).alias("key_floor"), (F.least(ceil, F.col("total")) - 1).alias("key_ceil"))


SWEEP = (0, 15, 30, 60, 90, 150)


@query(f"{RUNS_SQL}, " + ", ".join(_merged_sql(k, f"m{k}") for k in SWEEP) + " " + " UNION ALL ".join(f"SELECT lane, CAST({k} AS BIGINT) AS gap, count(*) AS intervals, CAST(sum(end_frame - start_frame + 1) AS BIGINT) AS frames FROM m{k} GROUP BY lane" for k in SWEEP))
def coverage_sweep(spark, sf_dir):
    """Intervals and frames under each gap; all gaps in one pass: a gap is a key, and starts are moved back by it to merge."""
    d = _intervals(spark, sf_dir).withColumn("gap", F.explode(F.array(*[F.lit(k).cast("long") for k in SWEEP]))).withColumn("start_frame", F.col("start_frame") - F.col("gap"))
    m = isl.coalesce_spread(d, ["lane", "gap"], "start_frame", "end_frame", 1, SPREAD).withColumn("start_frame", F.col("start_frame") + F.col("gap"))
    return m.groupBy("lane", "gap").agg(F.count(F.lit(1)).alias("intervals"), F.sum(F.col("end_frame") - F.col("start_frame") + 1).alias("frames"))


# ---------------------------------------------------------------- identity

PROFILE_SQL = f"""WITH {TRACKED_SQL}, pf AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame, event_id) AS rn, row_number() OVER (PARTITION BY track_id ORDER BY frame DESC, event_id DESC) AS rl FROM tracked),
prof AS (SELECT track_id, count(*) AS n, min(t) AS t0, max(t) AS t1, max(conf) AS peak, {", ".join(f"max(CASE WHEN rn = 1 THEN {c} END) AS a{c}, max(CASE WHEN rl = 1 THEN {c} END) AS z{c}" for c in BOX)} FROM pf GROUP BY track_id)"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = F.struct("frame", "event_id"), F.struct("frame", "event_id")
    box = F.struct(*BOX)
    d = tracked(spark, sf_dir).groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.max("conf").alias("peak"), F.min_by(box, first).alias("a"), F.max_by(box, last).alias("z"))
    return d.select("track_id", "n", "t0", "t1", "peak", *[F.col(f"a.{c}").alias(f"a{c}") for c in BOX], *[F.col(f"z.{c}").alias(f"z{c}") for c in BOX])


@query(f"{PROFILE_SQL} SELECT track_id, n, round(t0, 3) AS t0, round(t1, 3) AS t1, round(peak, 4) AS peak, {', '.join(f'a{c}, z{c}' for c in BOX)} FROM prof")
def track_profiles(spark, sf_dir):
    d = profiles(spark, sf_dir)
    return d.select("track_id", "n", r4(F.col("t0"), 3).alias("t0"), r4(F.col("t1"), 3).alias("t1"), r4(F.col("peak")).alias("peak"), *[x + c for c in BOX for x in "az"])


MATCH_GAP = 6.0
#: The reference's gap (colour histograms) and number of successors; the best score beyond MATCH_GAP.
FULL_GAP, FULL_TOP, FAR_SCORE = 90.0, 25, 0.6 * math.exp(-MATCH_GAP / 3.0) + 0.4
SUCCESSOR_SQL = f"""{SEGMENTS_SQL}, ev AS (SELECT track_id, seg, min(t) AS t0, max(t) AS t1, {", ".join(f"arg_min({c}, (frame, event_id)) AS a{c}, arg_max({c}, (frame, event_id)) AS z{c}" for c in BOX)} FROM seg GROUP BY 1, 2),
cand AS (SELECT p.track_id AS from_track, p.seg AS from_seg, n.track_id AS to_track, n.seg AS to_seg, n.t0 - p.t1 AS gap,
    0.6 * exp(-greatest(0.0, n.t0 - p.t1) / 3.0) + 0.4 * greatest(0.0, 1 - {g.center_ratio_sql("p.z", "n.a")} / 4) AS score
    FROM ev p JOIN ev n ON n.t0 BETWEEN p.t1 - 0.05 AND p.t1 + {FULL_GAP} AND (p.track_id <> n.track_id OR p.seg <> n.seg))"""


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments (track, seg, t0, t1), and their ends and starts with the box there, as nearest.top_links takes them."""
    e = presence(spark, sf_dir)
    key, box = F.struct("frame", "event_id"), F.struct(*BOX)
    e = cut(e.groupBy(F.col("track_id").alias("track"), "seg").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.min_by(box, key).alias("a"), F.max_by(box, key).alias("z")))
    return e.select("track", "seg", "t0", "t1"), e.select("track", "seg", F.col("t1").alias("t"), "z.*"), e.select("track", "seg", F.col("t0").alias("t"), "a.*")


#: What top_links finds, as a link from an end to a start.
_FORTH = {"q_track": "from_track", "q_seg": "from_seg", "o_track": "to_track", "o_seg": "to_seg"}
_BACK = {"q_track": "to_track", "q_seg": "to_seg", "o_track": "from_track", "o_seg": "from_seg"}


@query(f"{SUCCESSOR_SQL} SELECT from_track, from_seg, count(*) AS candidates, round(max(score), 4) AS best, round(min(gap), 3) AS least_gap FROM cand GROUP BY 1, 2")
def successor_candidates(spark, sf_dir):
    """How many starts lie within FULL_GAP of each end, the best score and the least gap, without the pairs.

    Counts and least gaps come from the sorted starts, scores from the one best link. A segment that begins within its
    own window is no candidate of its own.
    """
    e, ends, starts = _links(spark, sf_dir)
    best = nearest.top_links(ends, starts, 1, FULL_GAP).select(F.col("q_track").alias("track"), F.col("q_seg").alias("seg"), "score")
    d = nearest.within(e.withColumns({"lo": F.col("t1") - 0.05, "hi": F.col("t1") + FULL_GAP}), e, "lo", "hi", "t0")
    own = F.col("t0") >= F.col("lo")
    first = F.when(own & (F.col("first") == F.col("t0")), F.col("second")).otherwise(F.col("first"))
    d = d.withColumns({"candidates": F.col("inside") - own.cast("long"), "gap": first - F.col("t1")}).filter("candidates > 0")
    return d.join(best, ["track", "seg"]).select(F.col("track").alias("from_track"), F.col("seg").alias("from_seg"), "candidates", r4(F.col("score")).alias("best"), r4(F.col("gap"), 3).alias("least_gap"))


_RANK = "round(score, 9) DESC, to_track, to_seg"


@query(f"{SUCCESSOR_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY from_track, from_seg ORDER BY {_RANK}) AS rank FROM cand) SELECT from_track, from_seg, to_track, to_seg, CAST(rank AS INTEGER) AS rank, round(score, 4) AS score FROM k WHERE rank <= {FULL_TOP}")
def top_successors(spark, sf_dir):
    _, ends, starts = _links(spark, sf_dir)
    d = nearest.top_links(ends, starts, FULL_TOP, FULL_GAP).withColumnsRenamed(_FORTH)
    return d.select(*_FORTH.values(), "rank", r4(F.col("score")).alias("score"))


@query(f"""{SUCCESSOR_SQL}, s1 AS (SELECT *, row_number() OVER (PARTITION BY from_track, from_seg ORDER BY {_RANK}) AS r, row_number() OVER (PARTITION BY to_track, to_seg ORDER BY round(score, 9) DESC, from_track, from_seg) AS q FROM cand)
SELECT from_track, from_seg, to_track, to_seg, round(score, 4) AS score FROM s1 WHERE r = 1 AND q = 1 AND score >= 0.5""")
def mutual_best_links(spark, sf_dir):
    """MATCH_GAP is enough: a link that scores 0.5 is above FAR_SCORE, as all that outrank it."""
    _, ends, starts = _links(spark, sf_dir)
    forth = cut(nearest.top_links(ends, starts, 1, MATCH_GAP, least=0.5).withColumnsRenamed(_FORTH))
    met = starts.join(forth.select(F.col("to_track").alias("track"), F.col("to_seg").alias("seg")).distinct(), ["track", "seg"], "left_semi")
    back = nearest.top_links(met, ends, 1, MATCH_GAP, least=0.5, backward=True).withColumnsRenamed(_BACK).select(*_FORTH.values())
    return forth.join(back, list(_FORTH.values())).select(*_FORTH.values(), r4(F.col("score")).alias("score"))


# ---------------------------------------------------------------- evaluation

CLIP = 20.0
GT_SQL = f"""{FACE_SQL}, 
gt AS (SELECT track_id AS gt_id, t0 AS g0, t1 + 0.5 AS g1 FROM tiered WHERE seg = 0),
pred AS (SELECT track_id * 1048576 + seg AS pred_id, track_id, t0 AS p0, t1 + 0.2 AS p1 FROM tiered WHERE tier <> 'low_conf'),
clips AS (SELECT c AS clip_id, c * {CLIP} AS c0, (c + 1) * {CLIP} AS c1 FROM (SELECT unnest(range(0, CAST(floor(greatest((SELECT max(g1) FROM gt), (SELECT max(p1) FROM pred)) / {CLIP}) AS BIGINT) + 1)) AS c))"""


def _clips(gt, pred):
    """As many clips as the last event needs."""
    last = gt.agg(F.max("g1").alias("e")).unionByName(pred.agg(F.max("p1").alias("e"))).agg(F.max("e").alias("e")).filter("e IS NOT NULL")
    clips = last.select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("e") / CLIP))).alias("clip_id"))
    return clips.select("clip_id", (F.col("clip_id") * CLIP).alias("c0"), ((F.col("clip_id") + 1) * CLIP).alias("c1"))


def _gt_pred(spark, sf_dir):
    f = faces(spark, sf_dir)
    gt = f.filter("seg = 0").select(F.col("track_id").alias("gt_id"), F.col("t0").alias("g0"), (F.col("t1") + 0.5).alias("g1"))
    pred = f.filter("tier <> 'low_conf'").select(part_id("track_id", "seg").alias("pred_id"), "track_id", F.col("t0").alias("p0"), (F.col("t1") + 0.2).alias("p1"))
    return gt, pred


@query(f"{GT_SQL} SELECT clip_id, count(*) AS gt_events, round(sum(least(g1, c1) - greatest(g0, c0)), 3) AS overlap_sec FROM clips JOIN gt ON g0 < c1 AND g1 > c0 GROUP BY clip_id")
def clip_overlap(spark, sf_dir):
    """Events of each clip: every event names the clips that it touches, so this is an equi-join."""
    gt, pred = _gt_pred(spark, sf_dir)
    return _clip_overlap(gt, _clips(gt, pred))


def _clip_overlap(gt, clips):
    d = gt.withColumn("clip_id", F.explode(F.sequence(F.floor(F.col("g0") / CLIP), F.floor(F.col("g1") / CLIP)))).join(clips, "clip_id").filter("g0 < c1 AND g1 > c0")
    return d.groupBy("clip_id").agg(F.count(F.lit(1)).alias("gt_events"), r4(F.sum(F.least("g1", "c1") - F.greatest("g0", "c0")), 3).alias("overlap_sec"))


def _merge_split(gt, pred):
    o = gt.join(pred, (F.col("track_id") == F.col("gt_id")) & (F.col("p1") > F.col("g0")) & (F.col("p0") < F.col("g1")))
    big = o.filter((F.least("g1", "p1") - F.greatest("g0", "p0")) / (F.col("g1") - F.col("g0")) >= 0.25)
    a = big.groupBy(F.col("gt_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("over_split").alias("kind"), "id", "n")
    return a.unionByName(big.groupBy(F.col("pred_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("over_merge").alias("kind"), "id", "n"))


@query(f"""{GT_SQL}, grid AS (SELECT clip_id, c0 * 10 + u.range AS step FROM clips, range(0, {int(CLIP * 10)}) u),
gm AS (SELECT DISTINCT unnest(range(CAST(ceil(round(g0 * 10, 6)) AS BIGINT), CAST(floor(round(g1 * 10, 6)) AS BIGINT) + 1)) AS step FROM gt),
pm AS (SELECT DISTINCT unnest(range(CAST(ceil(round(p0 * 10, 6)) AS BIGINT), CAST(floor(round(p1 * 10, 6)) AS BIGINT) + 1)) AS step FROM pred)
SELECT clip_id, count(gm.step) AS gt_steps, count(pm.step) AS pred_steps, count(CASE WHEN pm.step IS NOT NULL AND gm.step IS NULL THEN 1 END) AS false_steps, count(CASE WHEN gm.step IS NOT NULL AND pm.step IS NULL THEN 1 END) AS miss_steps,
    round(count(CASE WHEN gm.step IS NOT NULL AND pm.step IS NOT NULL THEN 1 END) / nullif(CAST(count(gm.step) + count(pm.step) - count(CASE WHEN gm.step IS NOT NULL AND pm.step IS NOT NULL THEN 1 END) AS DOUBLE), 0), 4) AS mask_iou
FROM grid LEFT JOIN gm USING (step) LEFT JOIN pm USING (step) GROUP BY clip_id""")
def mask_errors(spark, sf_dir):
    """Covered tenths of a second of ground truth and prediction in each clip."""
    gt, pred = _gt_pred(spark, sf_dir)
    return _mask_errors(gt, pred, _clips(gt, pred))


def _mask_errors(gt, pred, clips):
    steps = lambda d, a, b, name: d.select(F.explode(F.sequence(F.ceil(F.round(F.col(a) * 10, 6)), F.floor(F.round(F.col(b) * 10, 6)))).alias("step")).distinct().withColumn(name, F.lit(1))
    grid = clips.select("clip_id", F.explode(F.sequence((F.col("c0") * 10).cast("long"), (F.col("c1") * 10 - 1).cast("long"))).alias("step"))
    d = grid.join(steps(gt, "g0", "g1", "g"), "step", "left").join(steps(pred, "p0", "p1", "p"), "step", "left")
    both = F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull())
    return d.groupBy("clip_id").agg(F.count("g").alias("gt_steps"), F.count("p").alias("pred_steps"), F.count_if(F.col("p").isNotNull() & F.col("g").isNull()).alias("false_steps"), F.count_if(F.col("g").isNotNull() & F.col("p").isNull()).alias("miss_steps"), r4(F.try_divide(both, F.count("g") + F.count("p") - both)).alias("mask_iou"))


# ---------------------------------------------------------------- grouped solvers, no SQL

@query()
def greedy_matches(spark, sf_dir):
    """Ground truth and predictions of a track by falling interval IoU, each once; all tracks."""
    gt, pred = _gt_pred(spark, sf_dir)
    o = gt.join(pred, F.col("track_id") == F.col("gt_id")).withColumn("iou", F.greatest(F.lit(0.0), F.least("g1", "p1") - F.greatest("g0", "p0")) / (F.greatest("g1", "p1") - F.least("g0", "p0"))).filter("iou >= 0.3")
    return matching.greedy_pairs(o.select("track_id", "gt_id", "pred_id", r4(F.col("iou")).alias("iou")), "track_id", "gt_id", "pred_id", "iou")


@query()
def frame_nms(spark, sf_dir):
    """Boxes of each frame of a video that no better box of the frame overlaps by more than 0.70."""
    return matching.suppress(tracked(spark, sf_dir), ["video_id", "frame"], 0.7).select("video_id", "frame", "event_id", "conf")


@query()
def assigned_links(spark, sf_dir):
    """Maximum-weight links of all segments, each end once, over the FULL_TOP best candidates of score 0.5 at least.

    A candidate more than MATCH_GAP behind scores FAR_SCORE at most, so none of FULL_GAP is lost. Connected components
    of the candidates share no end: solved apart, they give the optimum of the whole.
    """
    _, ends, starts = _links(spark, sf_dir)
    d = nearest.top_links(ends, starts, FULL_TOP, MATCH_GAP, digits=4, least=0.5).withColumnsRenamed(_FORTH)
    d = cut(d.select(part_id("from_track", "from_seg").alias("from_id"), part_id("to_track", "to_seg").alias("to_id"), r4(F.col("score")).alias("score")))
    u, v = F.col("from_id") * 2, F.col("to_id") * 2 + 1  # a segment's end and its start are two nodes
    roots = components(d.select(u.alias("u"), v.alias("v")))
    d = d.withColumn("node", v).join(roots, "node", "left").withColumn("part", F.coalesce("root", "node"))
    return matching.assignment(d.select("part", "from_id", "to_id", "score"), "part")


@query()
def singleton_rescue(spark, sf_dir):
    d = isl.islands(tracked(spark, sf_dir), ["track_id"], ORDER, lambda d: d["t"] - d["prev_t"] >= 1.0, ["t"], "chunk")
    c = d.groupBy("track_id", "chunk").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count(F.lit(1)).alias("n"))
    return matching.rescue_singletons(c, "track_id", 1.5)


# ---------------------------------------------------------------- the same under their former names
# Before, the queries without "whole_" ran over some tracks and the first frames only. Now both take all rows.

for _f in (merged_intervals, segment_plan, keyframe_snap, coverage_sweep, successor_candidates, top_successors, mutual_best_links, clip_overlap, mask_errors):
    QUERIES[f"whole_{_f.__name__}"] = globals()[f"whole_{_f.__name__}"] = _f
    SQL[f"whole_{_f.__name__}"] = SQL[_f.__name__]


@query()
def whole_merge_split_errors(spark, sf_dir):
    """How many predictions of its track cover a quarter of each ground truth, and the other way round (errors: merge_split_errors)."""
    return _merge_split(*_gt_pred(spark, sf_dir))
