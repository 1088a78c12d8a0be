"""Statistics of tracks, events and detections, comparisons of schemes and runs, and recommended parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import scalars as s
from ..operators import islands as isl
from ..sources.tracked import FPS, INTERVAL, TRACKED_SQL, tracked
from .behavior import SEG_EVENT_SQL, TRACK_SQL, event_sql, make_events, presence_events, quality_sql, scored, timecode, timecode_sql, track_events
from .identity import PIECES_SQL
from .registry import BOX, ORDER, query, r4


@query(f"""WITH {TRACK_SQL}, e AS (SELECT *, round(end_time - start_time, 3) AS d FROM tnum) SELECT video_id, count(*) AS event_total, round(sum(CAST(round(d * 1000) AS BIGINT)) / 1000.0 / count(*), 3) AS event_avg_duration_sec, round(CAST(sum(n) AS DOUBLE) / count(*) + 0.000000001, 2) AS event_avg_frame_count, arg_max(num, (d, -num)) AS longest_event, arg_min(num, (d, num)) AS shortest_event, max(d) AS longest_sec, min(d) AS shortest_sec FROM e GROUP BY 1""")
def event_statistics(spark, sf_dir):
    """Averages and extremes of the events of a video, the first one on ties."""
    e = track_events(spark, sf_dir).withColumn("d", r4(F.col("end_time") - F.col("start_time"), 3))
    n = F.count(F.lit(1))
    return e.groupBy("video_id").agg(n.alias("event_total"), r4(F.sum(F.round(F.col("d") * 1000).cast("long")) / F.lit(1000.0) / n, 3).alias("event_avg_duration_sec"), r4(F.sum("n").cast("double") / n + 1e-9, 2).alias("event_avg_frame_count"), F.max_by("num", F.struct(F.col("d"), -F.col("num"))).alias("longest_event"), F.min_by("num", F.struct("d", "num")).alias("shortest_event"), F.max("d").alias("longest_sec"), F.min("d").alias("shortest_sec"))


@query(f"""WITH {TRACKED_SQL} SELECT video_id, track_id, count(*) AS detection_count, round(min(t), 3) AS start_time, round(max(t), 3) AS end_time, {timecode_sql("round(min(t), 3)")} AS start_timecode, {timecode_sql("round(max(t), 3)")} AS end_timecode, round(max(t) - min(t), 3) AS duration_sec, min(frame) AS start_frame, max(frame) AS end_frame FROM tracked GROUP BY 1, 2""")
def track_statistics(spark, sf_dir):
    t = tracked(spark, sf_dir).groupBy("video_id", "track_id").agg(F.count(F.lit(1)).alias("detection_count"), r4(F.min("t"), 3).alias("start_time"), r4(F.max("t"), 3).alias("end_time"), r4(F.max("t") - F.min("t"), 3).alias("duration_sec"), F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"))
    return t.select("*", timecode(F.col("start_time")).alias("start_timecode"), timecode(F.col("end_time")).alias("end_timecode"))


_SCHEME = """SELECT '{0}' AS scheme, count(*) AS event_total, round(sum(CAST(round((end_time - start_time) * 1000) AS BIGINT)) / 1000.0 / count(*), 3) AS avg_duration_sec, count(*) FILTER (n = 1) AS single_frame_event_count, count(*) FILTER (quality = 'LOW') AS low_quality_event_count, count(*) FILTER (quality = 'MEDIUM') AS medium_quality_event_count, count(*) FILTER (quality = 'HIGH') AS high_quality_event_count, round(count(*) * 0.5, 1) AS review_time_min FROM {1}"""
_SCHEME_COLS = ("event_total", "avg_duration_sec", "single_frame_event_count", "low_quality_event_count", "medium_quality_event_count", "high_quality_event_count", "review_time_min")


@query(f"""WITH {SEG_EVENT_SQL}, {quality_sql("se", "cq")}, lg AS (SELECT * EXCLUDE (gap), CAST(sum(CASE WHEN gap >= 1.0 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY frame, event_id) AS BIGINT) AS chunk FROM pieces), {event_sql("lg", "track_id, chunk", "be")}, {quality_sql("be", "bq")}, both2 AS ({_SCHEME.format("B_time_only", "bq")} UNION ALL {_SCHEME.format("C_time_hard_split", "cq")})
SELECT * FROM both2 UNION ALL SELECT 'C_minus_B', {", ".join(f"c.{x} - b.{x}" if x not in ("avg_duration_sec", "review_time_min") else f"round(c.{x} - b.{x}, 3)" for x in _SCHEME_COLS)} FROM both2 b, both2 c WHERE b.scheme = 'B_time_only' AND c.scheme = 'C_time_hard_split'""")
def scheme_comparison(spark, sf_dir):
    """Two ways to cut tracks into events, summarised, and their difference."""
    b = make_events(isl.islands(tracked(spark, sf_dir), ["track_id"], ORDER, lambda d: d["t"] - d["prev_t"] >= 1.0, ["t"], "chunk"), ["track_id", "chunk"])

    def summary(e: DataFrame, name: str) -> DataFrame:
        n, q = F.count(F.lit(1)), lambda x: F.count_if(F.col("quality") == x)
        dur = F.sum(F.round((F.col("end_time") - F.col("start_time")) * 1000).cast("long")) / F.lit(1000.0) / n
        return scored(e).agg(n.alias("event_total"), r4(dur, 3).alias("avg_duration_sec"), F.count_if(F.col("n") == 1).alias("single_frame_event_count"), q("LOW").alias("low_quality_event_count"), q("MEDIUM").alias("medium_quality_event_count"), q("HIGH").alias("high_quality_event_count"), r4(n * 0.5, 1).alias("review_time_min")).withColumn("scheme", F.lit(name))

    rows = summary(b, "B_time_only").unionByName(summary(presence_events(spark, sf_dir), "C_time_hard_split"))
    wide = rows.groupBy().pivot("scheme", ["B_time_only", "C_time_hard_split"]).agg(*[F.first(c).alias(c) for c in _SCHEME_COLS])
    diff = lambda c: F.col(f"C_time_hard_split_{c}") - F.col(f"B_time_only_{c}")
    delta = wide.select(F.lit("C_minus_B").alias("scheme"), *[(r4(diff(c), 3) if c in ("avg_duration_sec", "review_time_min") else diff(c)).alias(c) for c in _SCHEME_COLS])
    return rows.select("scheme", *_SCHEME_COLS).unionByName(delta)


SUMMARY_SQL = f"""{TRACKED_SQL}, sm AS (SELECT video_id, count(*) AS total, count(DISTINCT frame) AS sampled, round(sum(CAST(round(conf * 1000000) AS BIGINT)) / 1000000.0 / count(*), 4) AS avg_conf, round(count(*) / ((max(frame) + 1) / {FPS} / 60), 3) AS per_minute, (max(frame) + 1) / {FPS} AS dur FROM tracked GROUP BY 1),
bins AS (SELECT video_id, least(19, CAST(floor(round(conf * 1000) / 50) AS BIGINT)) * 0.05 + 0.025 AS mid, count(*) AS c FROM tracked GROUP BY 1, 2),
hs AS (SELECT video_id, round(sum(CASE WHEN mid < 0.45 THEN c ELSE 0 END) / CAST(sum(c) AS DOUBLE), 4) AS very_low, round(sum(CASE WHEN mid < 0.50 THEN c ELSE 0 END) / CAST(sum(c) AS DOUBLE), 4) AS low, round(sum(CASE WHEN mid >= 0.50 AND mid < 0.75 THEN c ELSE 0 END) / CAST(sum(c) AS DOUBLE), 4) AS borderline, round(sum(CASE WHEN mid >= 0.75 THEN c ELSE 0 END) / CAST(sum(c) AS DOUBLE), 4) AS high FROM bins GROUP BY 1)"""


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, mean confidence, rate and histogram shares (by the middles of the bins) of each video."""
    d = tracked(spark, sf_dir)
    n = F.count(F.lit(1))
    bin_ = F.least(F.lit(19), F.floor(F.round(F.col("conf") * 1000) / 50))
    # by video and bin first: shares are sums over a few rows
    by_bin = d.groupBy("video_id", bin_.alias("bin")).agg(n.alias("c"), F.max("frame").alias("last"), F.sum(F.round(F.col("conf") * 1_000_000).cast("long")).alias("m"))
    mid, total = F.col("bin") * 0.05 + 0.025, F.sum("c")
    share = lambda cond: r4(F.sum(F.when(cond, F.col("c")).otherwise(0)) / total)
    sm = by_bin.groupBy("video_id").agg(total.alias("total"), r4(F.sum("m") / F.lit(1_000_000.0) / total).alias("avg_conf"), r4(total / ((F.max("last") + 1) / FPS / 60), 3).alias("per_minute"), ((F.max("last") + 1) / FPS).alias("dur"), share(mid < 0.45).alias("very_low"), share(mid < 0.50).alias("low"), share((mid >= 0.50) & (mid < 0.75)).alias("borderline"), share(mid >= 0.75).alias("high"))
    sampled = d.groupBy("video_id").agg(F.count_distinct("frame").alias("sampled"))
    return sm.join(sampled, "video_id")


@query(f"WITH {SUMMARY_SQL} SELECT video_id, total AS total_detections, sampled AS sampled_frames, avg_conf AS avg_confidence, per_minute AS detections_per_minute, very_low AS very_low_ratio, low AS low_ratio, borderline AS borderline_ratio, high AS high_ratio FROM sm JOIN hs USING (video_id)")
def video_summaries(spark, sf_dir):
    return summaries(spark, sf_dir).select("video_id", F.col("total").alias("total_detections"), F.col("sampled").alias("sampled_frames"), F.col("avg_conf").alias("avg_confidence"), F.col("per_minute").alias("detections_per_minute"), F.col("very_low").alias("very_low_ratio"), F.col("low").alias("low_ratio"), F.col("borderline").alias("borderline_ratio"), F.col("high").alias("high_ratio"))


_PAD = 2 * INTERVAL / FPS


@query(f"""WITH {SUMMARY_SQL}, x AS (SELECT *, round(total / CAST(sampled AS DOUBLE), 4) AS density FROM sm JOIN hs USING (video_id)),
c0 AS (SELECT *, 0.35 + CASE WHEN very_low >= 0.25 THEN 0.10 WHEN low >= 0.40 THEN 0.08 WHEN low >= 0.28 THEN 0.05 ELSE 0.0 END AS k0 FROM x), c1 AS (SELECT *, CASE WHEN avg_conf < 0.50 THEN greatest(k0, 0.45) WHEN avg_conf < 0.58 THEN greatest(k0, 0.40) ELSE k0 END AS k1 FROM c0), c2 AS (SELECT *, CASE WHEN high >= 0.45 AND low < 0.20 AND avg_conf >= 0.65 THEN least(k1, 0.35) ELSE k1 END AS k2 FROM c1),
g0 AS (SELECT *, CASE WHEN per_minute >= 120 THEN 0.8 WHEN per_minute >= 70 THEN 1.0 WHEN per_minute >= 35 THEN 1.2 ELSE 1.5 END AS gap0, CASE WHEN per_minute >= 120 THEN 'high_detection_density' WHEN per_minute >= 70 THEN 'moderate_high_density' WHEN per_minute >= 35 THEN 'moderate_density' ELSE 'sparse_faces' END AS why FROM c2)
SELECT video_id, round(round(least(0.55, greatest(0.30, k2)) * 20) / 20, 2) AS recommended_conf, round(least(2.0, greatest(0.5, CASE WHEN density >= 0.35 THEN greatest(0.7, gap0 - 0.2) ELSE gap0 END)), 2) AS recommended_event_gap, why || CASE WHEN density >= 0.35 THEN '; dense_sampled_frames' ELSE '' END AS gap_reason,
    round(least(0.30, greatest(0.20, {_PAD})), 3) AS pre_padding_sec, round(least(0.50, greatest(CASE WHEN per_minute < 50 THEN least(0.50, round(least(0.50, greatest(0.30, {_PAD})) * 1.2, 3)) WHEN per_minute >= 100 THEN greatest(least(0.50, greatest(0.30, {_PAD})), 0.33) ELSE least(0.50, greatest(0.30, {_PAD})) END, {round((2 * INTERVAL + 2) / FPS, 3)})), 3) AS post_padding_sec,
    CASE WHEN per_minute >= 90 OR dur >= 300 THEN 'extreme' WHEN avg_conf < 0.60 OR low >= 0.30 THEN 'extreme' WHEN avg_conf >= 0.68 AND high >= 0.35 THEN 'high' ELSE 'extreme' END AS recommended_mosaic_level FROM g0""")
def recommended_parameters(spark, sf_dir):
    """Threshold ladders over each video's statistics: confidence, gap, padding, strength of the mosaic."""
    d = summaries(spark, sf_dir).withColumn("density", r4(F.col("total") / F.col("sampled")))
    c, low, high, pm = F.col("avg_conf"), F.col("low"), F.col("high"), F.col("per_minute")
    k0 = 0.35 + F.when(F.col("very_low") >= 0.25, 0.10).when(low >= 0.40, 0.08).when(low >= 0.28, 0.05).otherwise(0.0)
    k1 = F.when(c < 0.50, F.greatest(k0, F.lit(0.45))).when(c < 0.58, F.greatest(k0, F.lit(0.40))).otherwise(k0)
    k2 = F.when((high >= 0.45) & (low < 0.20) & (c >= 0.65), F.least(k1, F.lit(0.35))).otherwise(k1)
    gap0 = F.when(pm >= 120, 0.8).when(pm >= 70, 1.0).when(pm >= 35, 1.2).otherwise(1.5)
    why = F.when(pm >= 120, "high_detection_density").when(pm >= 70, "moderate_high_density").when(pm >= 35, "moderate_density").otherwise("sparse_faces")
    dense = F.col("density") >= 0.35
    pad = min(0.50, max(0.30, _PAD))
    post = F.when(pm < 50, min(0.50, round(pad * 1.2, 3))).when(pm >= 100, max(pad, 0.33)).otherwise(pad)
    mosaic = F.when((pm >= 90) | (F.col("dur") >= 300), "extreme").when((c < 0.60) | (low >= 0.30), "extreme").when((c >= 0.68) & (high >= 0.35), "high").otherwise("extreme")
    return d.select(
        "video_id", F.round(F.rint(F.least(F.lit(0.55), F.greatest(F.lit(0.30), k2)) * 20) / 20, 2).alias("recommended_conf"), r4(F.least(F.lit(2.0), F.greatest(F.lit(0.5), F.when(dense, F.greatest(F.lit(0.7), gap0 - 0.2)).otherwise(gap0))), 2).alias("recommended_event_gap"), F.concat(why, F.when(dense, "; dense_sampled_frames").otherwise("")).alias("gap_reason"),
        F.lit(round(min(0.30, max(0.20, _PAD)), 3)).alias("pre_padding_sec"), r4(F.least(F.lit(0.50), F.greatest(post, F.lit(round((2 * INTERVAL + 2) / FPS, 3)))), 3).alias("post_padding_sec"), mosaic.alias("recommended_mosaic_level"),
    )


# ---------------------------------------------------------------- samples and labels

@query(f"""WITH {PIECES_SQL}, r AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY piece) AS n FROM pieces WINDOW w AS (PARTITION BY piece ORDER BY frame, event_id)),
pick AS (SELECT piece, n, list_distinct([CAST(round_even(k * (n - 1) / 3.0, 0) AS BIGINT) FOR k IN [0, 1, 2, 3]]) AS rounded, list_distinct([CAST(floor(k * (n - 1) / 3.0) AS BIGINT) FOR k IN [0, 1, 2, 3]]) AS cut FROM (SELECT DISTINCT piece, n FROM r))
SELECT piece, n, (SELECT frame FROM r WHERE r.piece = p.piece AND i = n // 2) AS middle_frame, CASE WHEN n <= 4 THEN n ELSE len(rounded) END AS samples, array_to_string(list_sort(CASE WHEN n <= 4 THEN range(0, n) ELSE rounded END), ',') AS rounded_samples, array_to_string(list_sort(cut), ',') AS cut_samples FROM pick p""")
def even_samples(spark, sf_dir):
    """Four detections of each piece at even distances, rounded and cut off, and the middle one."""
    from .identity import pieces

    w = Window.partitionBy("track_id", "piece").orderBy(*ORDER)
    d = pieces(spark, sf_dir).withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("track_id", "piece")))
    d = d.groupBy("piece").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("i") == F.floor(F.col("n") / 2), F.col("frame"))).alias("middle_frame"))
    k, m = F.array(*[F.lit(x) for x in range(4)]), F.col("n") - 1
    rounded, cut = F.array_sort(F.array_distinct(F.transform(k, lambda x: F.rint(x * m / 3.0).cast("long")))), F.array_sort(F.array_distinct(F.transform(k, lambda x: F.floor(x * m / 3.0))))
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    some = F.when(F.col("n") <= 4, F.sequence(F.lit(0).cast("long"), m)).otherwise(rounded)
    return d.select("piece", "n", "middle_frame", F.size(some).cast("long").alias("samples"), text(some).alias("rounded_samples"), text(cut).alias("cut_samples"))


@query(f"""WITH {TRACKED_SQL}, d AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY video_id, frame) AS m FROM tracked)
SELECT video_id, frame, event_id, CASE WHEN m > 1 THEN printf('frame_%06d_d%02d_conf_%.3f.jpg', frame, i, round(conf, 3)) ELSE printf('frame_%06d_conf_%.3f.jpg', frame, round(conf, 3)) END AS image_name, printf('ID %d conf %.2f', track_id, round(conf, 2)) AS label FROM d""")
def image_names_and_labels(spark, sf_dir):
    """File names of frames' boxes, numbered where a frame has more than one, and label lines."""
    w = Window.partitionBy("video_id", "frame")
    d = tracked(spark, sf_dir).withColumn("i", F.row_number().over(w.orderBy("event_id")) - 1).withColumn("m", F.count(F.lit(1)).over(w))
    c = F.round("conf", 3)
    name = F.when(F.col("m") > 1, F.format_string("frame_%06d_d%02d_conf_%.3f.jpg", "frame", "i", c)).otherwise(F.format_string("frame_%06d_conf_%.3f.jpg", "frame", c))
    return d.select("video_id", "frame", "event_id", name.alias("image_name"), F.format_string("ID %d conf %.2f", "track_id", F.round("conf", 2)).alias("label"))


@query(f"""WITH {TRACKED_SQL}, b AS (SELECT video_id, frame, event_id, conf, {", ".join(BOX)} FROM tracked WHERE frame % 15 = 0), c AS (SELECT video_id, frame, event_id, {", ".join(f"{x} + 30 AS {x}" if x[0] == "x" else x for x in BOX)} FROM tracked WHERE frame % 15 = 0 AND event_id % 4 <> 0)
SELECT coalesce(b.video_id, c.video_id) AS video_id, count(DISTINCT b.event_id) AS baseline_boxes, count(DISTINCT c.event_id) AS candidate_boxes, count(DISTINCT coalesce(b.frame, c.frame)) AS frames FROM b FULL JOIN c USING (video_id, frame, event_id) GROUP BY 1""")
def common_frame_boxes(spark, sf_dir):
    """Boxes of two runs on the frames that both sample (a multiple of both strides, 3 and 5)."""
    b, c = runs_of_boxes(spark, sf_dir)
    d = b.withColumn("base", F.lit(1)).unionByName(c.withColumn("base", F.lit(0)))
    return d.groupBy("video_id").agg(F.sum("base").alias("baseline_boxes"), F.sum(1 - F.col("base")).alias("candidate_boxes"), F.count_distinct("frame").alias("frames"))


def runs_of_boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = tracked(spark, sf_dir).filter(F.col("frame") % 15 == 0).select("video_id", "frame", "event_id", *BOX)
    moved = d.filter("event_id % 4 <> 0").withColumn("x1", F.col("x1") + 30).withColumn("x2", F.col("x2") + 30)
    return d, moved


@query()
def frame_box_matches(spark, sf_dir):
    """Boxes of two runs matched by frame: each baseline box in turn takes the best free candidate of IoU 0.3 (no SQL: tested against a loop)."""
    from ..operators import matching

    b, c = runs_of_boxes(spark, sf_dir)
    j = b.select("video_id", "frame", F.col("event_id").alias("base_id"), *[F.col(x).alias(f"b{x}") for x in BOX]).join(c.select("video_id", "frame", F.col("event_id").alias("cand_id"), *[F.col(x).alias(f"c{x}") for x in BOX]), ["video_id", "frame"])
    j = j.withColumn("iou", g.iou(g.box("b"), g.box("c"))).filter("iou >= 0.3")
    return matching.in_turn(j.select("video_id", "frame", "base_id", "cand_id", "iou"), ["video_id", "frame"], "base_id", "cand_id", "iou").withColumn("iou", r4(F.col("iou")))
