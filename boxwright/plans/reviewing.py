"""Rules of review over events, their trajectories and edge candidates; documents of the review pack and the audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import overlay, reviewing
from ..sources import sinks
from ..sources.shared import cut, new_path
from ..sources.tracked import FPS, HEIGHT, TRACKED_SQL, WIDTH, tracked, videos
from .behavior import SEG_EVENT_SQL, TRACK_SQL, presence_events, track_events
from .registry import BOX, query, r4
from .review import CAND_SQL, edge_candidates
from .timeline import PROPOSAL_SQL, proposals
from .trajectories import presence_trajectories

_LESS = overlay.PAD
#: The candidates' CTEs behind those that they share with proposals.
_CANDS = CAND_SQL[len(TRACK_SQL) + 2 :]
_LEVELS = tuple(overlay.LEVELS)


def _pixels_sql() -> str:
    """Boxes padded, then in pixels: the oracle's CTE px."""
    pad = f"greatest(0.0, x1 - (x2 - x1) * {_LESS}) AS a1, greatest(0.0, y1 - (y2 - y1) * {_LESS}) AS b1, least({WIDTH - 1}.0, x2 + (x2 - x1) * {_LESS}) AS a2, least({HEIGHT - 1}.0, y2 + (y2 - y1) * {_LESS}) AS b2"
    near = lambda c, m: f"CAST(greatest(0, least({m - 1}, round_even({c}, 0))) AS INTEGER)"
    whole = f"{near('a1', WIDTH)} AS p1, {near('b1', HEIGHT)} AS q1, {near('a2', WIDTH)} AS p2, {near('b2', HEIGHT)} AS q2"
    return f"px AS (SELECT video_id, event_id, p1, q1, CASE WHEN p2 <= p1 THEN least({WIDTH - 1}, p1 + 1) ELSE p2 END AS p2, CASE WHEN q2 <= q1 THEN least({HEIGHT - 1}, q1 + 1) ELSE q2 END AS q2 FROM (SELECT *, {whole} FROM (SELECT *, {pad} FROM tracked)))"


def _small_sql(side: str) -> str:
    return f"CASE WHEN {side} >= 1 THEN CAST(greatest(1, round_even(({side}) * share, 0)) AS INTEGER) ELSE 0 END"


@query(f"""WITH {TRACKED_SQL}, {_pixels_sql()}, lv AS (SELECT *, [{", ".join(f"'{k}'" for k in _LEVELS)}][CAST(video_id % 4 AS INTEGER) + 1] AS level, [{", ".join(f"CAST({v} AS DOUBLE)" for v in overlay.LEVELS.values())}][CAST(video_id % 4 AS INTEGER) + 1] AS share FROM px)
SELECT video_id, event_id, level, p1 AS x1, q1 AS y1, p2 AS x2, q2 AS y2, {_small_sql("p2 - p1")} AS mosaic_width, {_small_sql("q2 - q1")} AS mosaic_height FROM lv""")
def mosaic_regions(spark, sf_dir):
    """The pixels that each detection's mosaic covers and the size that they shrink to, by the level of its video."""
    d = tracked(spark, sf_dir)
    level = F.element_at(F.array(*[F.lit(x) for x in _LEVELS]), (F.col("video_id") % 4 + 1).cast("int"))
    b = overlay.in_pixels(overlay.padded(g.box(), WIDTH, HEIGHT), WIDTH, HEIGHT)
    d = d.select("video_id", "event_id", level.alias("level"), *[b[c].alias(c) for c in BOX]).withColumn("share", overlay.mosaic_share(F.col("level")))
    w, h = overlay.shrunk(F.col("x2") - F.col("x1"), F.col("share")), overlay.shrunk(F.col("y2") - F.col("y1"), F.col("share"))
    return d.select("video_id", "event_id", "level", *BOX, w.alias("mosaic_width"), h.alias("mosaic_height"))


_EDGE = f"(round(x1, 1) <= 2 OR round(y1, 1) <= 12 OR round(x2, 1) >= {WIDTH - 2} OR round(y2, 1) >= {HEIGHT - 2})"
_AREA = f"(x2 - x1) * (y2 - y1) / {WIDTH * HEIGHT}"


@query(f"""WITH {SEG_EVENT_SQL}, pt AS (SELECT track_id, seg, bool_or(round(conf, 4) < 0.55) AS faint, bool_or({_EDGE} AND {_AREA} > 0.03) AS large, bool_or({_EDGE} AND {_AREA} > 0.035) AS larger, bool_or(y1 <= 12 AND x2 - x1 >= 180 AND (x2 - x1) / greatest(1.0, y2 - y1) >= 1.35) AS wide FROM seg3 GROUP BY 1, 2)
SELECT video_id, printf('evt_%04d', num) AS event_id, faint OR large AS by_timeline, faint OR larger OR wide AS by_render FROM se JOIN pt USING (track_id, seg)""")
def explicit_accept_rules(spark, sf_dir):
    """Presence events that count only once accepted, by the timeline's rule and by the render's, from their trajectories."""
    e = presence_events(spark, sf_dir).select("video_id", "track_id", "seg", "num", "hints").join(videos(spark, sf_dir).select("video_id", "width", "height"), "video_id")
    d = e.join(presence_trajectories(spark, sf_dir), ["track_id", "seg"])
    rule = lambda render: reviewing.explicit_accept(F.col("hints"), F.col("trajectory"), F.col("width"), F.col("height"), render)
    return d.select("video_id", F.format_string("evt_%04d", "num").alias("event_id"), rule(False).alias("by_timeline"), rule(True).alias("by_render"))


_VERDICT_SQL = "CASE WHEN partial AND seconds >= 2.0 THEN 'edge_partial_long' WHEN partial THEN 'edge_partial_short_aggressive_fallback' WHEN tier = 'low_conf' AND peak >= 0.70 THEN 'low_conf_high_peak' WHEN tier = 'low_conf' AND clip AND peak >= 0.60 THEN 'low_conf_edge_clip' WHEN tier = 'low_conf' THEN 'low_conf_below_main_review_threshold' ELSE 'ordinary_review' END"

_EVERY_SQL = f"""{PROPOSAL_SQL}, {_CANDS}, every AS (SELECT video_id, proposal_id AS id, tier, round(peak, 4) AS peak, duration AS seconds, list_contains(hints, 'edge_clip') AS clip, false AS partial FROM prop WHERE tier <> 'auto'
    UNION ALL SELECT video_id, printf('bevt_edge_%04d', num), 'low_conf', 0.5, round((max(frame) - min(frame) + 1) / {FPS}, 3), false, true FROM cg GROUP BY video_id, num)"""

def _candidates(spark, sf_dir):
    """Edge candidates as proposals of low confidence."""
    c = edge_candidates(spark, sf_dir)
    return c.select("video_id", F.col("event_id").alias("id"), F.lit("low_conf").alias("tier"), F.lit(0.5).alias("peak"), r4((F.col("end_frame") - F.col("start_frame") + 1) / FPS, 3).alias("seconds"), F.array(F.lit("edge_partial_face_candidate")).alias("hints"))


def _to_review(spark, sf_dir):
    return proposals(spark, sf_dir).filter("tier <> 'auto'").select("video_id", F.col("proposal_id").alias("id"), "tier", r4(F.col("peak")).alias("peak"), F.col("duration").alias("seconds"), "hints")

@query(f"""WITH {_EVERY_SQL}
SELECT video_id, id, tier, seconds, {_VERDICT_SQL} AS reason, {_VERDICT_SQL} NOT IN ('edge_partial_short_aggressive_fallback', 'low_conf_below_main_review_threshold') AS keep FROM every""")
def main_review_verdicts(spark, sf_dir):
    """Proposals and edge candidates with the verdict of the main review and its reason."""
    p = _to_review(spark, sf_dir)
    v = reviewing.main_review(F.col("tier"), F.col("peak"), F.col("seconds"), F.col("hints"))
    return p.unionByName(_candidates(spark, sf_dir)).withColumn("v", v).select("video_id", "id", "tier", "seconds", F.col("v.reason").alias("reason"), F.col("v.keep").alias("keep"))


@query(f"WITH {TRACK_SQL} SELECT video_id, num AS event, CASE WHEN num % 4 = 3 THEN 0.0 ELSE round(start_time, 3) END AS start_sec, CASE WHEN num % 4 = 3 THEN 0.0 WHEN num % 4 = 2 THEN round(start_time, 3) - 1.0 ELSE round(end_time, 3) END AS end_sec, CASE WHEN num % 4 >= 2 THEN 0.0 ELSE greatest(0.0, round(end_time, 3) - round(start_time, 3)) END AS seconds FROM tnum")
def event_spans(spark, sf_dir):
    """Bounds of events read from documents that name them start_time and end_time, start and end, or not at all."""
    e = track_events(spark, sf_dir)
    k, a, z = F.col("num") % 4, r4(F.col("start_time"), 3), r4(F.col("end_time"), 3)
    doc = F.struct(F.col("num").alias("event"), F.when(k == 0, a).alias("start_time"), F.when(k == 0, z).alias("end_time"), F.when(k.isin(1, 2), a).alias("start"), F.when(k == 1, z).when(k == 2, a - 1.0).alias("end"))
    path = new_path(spark)
    e.select("video_id", F.to_json(doc).alias("value")).write.partitionBy("video_id").text(path)
    d = spark.read.schema("event long, start_time double, end_time double, start double, end double, video_id long").json(path)
    return d.select("video_id", "event", reviewing.event_start().alias("start_sec"), reviewing.event_end().alias("end_sec"), reviewing.event_seconds().alias("seconds"))


# ---------------------------------------------------------------- documents

@query(f"""WITH {_EVERY_SQL},
v AS (SELECT *, {_VERDICT_SQL} AS reason FROM every), q AS (SELECT *, reason IN ('edge_partial_short_aggressive_fallback', 'low_conf_below_main_review_threshold') AS out FROM v)
SELECT video_id, CASE WHEN out THEN 'suppressed' ELSE 'pending' END AS document, count(*) OVER (PARTITION BY video_id, out) AS listed, id, reason, CASE WHEN NOT out THEN 'event_contact_sheet/' || id || '.jpg' END AS contact_sheet FROM q WHERE out OR NOT partial""")
def review_pack_documents(spark, sf_dir):
    """The two documents of each video's review pack, written and read again: pending ones that have entries, and all suppressed ones."""
    p = cut(_to_review(spark, sf_dir))
    v = reviewing.main_review(F.col("tier"), F.col("peak"), F.col("seconds"), F.col("hints"))
    d = cut(p.unionByName(_candidates(spark, sf_dir)).withColumn("v", v).select("video_id", "id", F.col("v.reason").alias("reason"), F.col("v.keep").alias("keep")))
    pending, suppressed = sinks.review_pack(d, p, ["video_id", "id"], "keep")
    pending = pending.select("video_id", "id", "reason", F.concat(F.lit("event_contact_sheet/"), "id", F.lit(".jpg")).alias("contact_sheet"))
    root = new_path(spark)
    sinks.document(pending, {"schema": "mask_review_pack.v2"}, "events", ["video_id"]).write.text(f"{root}/document=pending")
    sinks.document(suppressed.select("video_id", "id", "reason"), {"schema": "mask_review_suppressed.v2"}, "events", ["video_id"]).write.text(f"{root}/document=suppressed")
    back = spark.read.schema("video_id long, document string, events array<struct<id:string,reason:string,contact_sheet:string>>").json(root)
    return back.select("video_id", "document", F.size("events").cast("long").alias("listed"), F.inline("events"))


@query(f"WITH {TRACK_SQL} SELECT video_id, count(*) OVER (PARTITION BY video_id) AS listed, printf('bevt_%04d', num) AS event_id, track_id, round(peak, 4) AS peak_confidence, start_frame, end_frame FROM tnum WHERE tier = 'auto'")
def audit_documents(spark, sf_dir):
    """Automatically accepted events of each video as the audit's JSON document, read again."""
    e = track_events(spark, sf_dir).filter("tier = 'auto'")
    rows = e.select("video_id", F.format_string("bevt_%04d", "num").alias("event_id"), "track_id", r4(F.col("peak")).alias("peak_confidence"), "start_frame", "end_frame")
    path = new_path(spark)
    sinks.document(rows, {"schema": "audit"}, "events", ["video_id"]).write.text(path)
    back = spark.read.schema("video_id long, events array<struct<event_id:string,track_id:long,peak_confidence:double,start_frame:long,end_frame:long>>").json(path)
    return back.select("video_id", F.size("events").cast("long").alias("listed"), F.inline("events"))
