"""Documents: JSON of detections, reports and logs written to the shared folder and read again in their schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers, sinks
from ..sources.shared import cut, new_path
from ..sources.tracked import FPS, TRACKED_SQL, tracked
from .behavior import TRACK_SQL, track_events
from .registry import BOX, query, r4
from .timeline import SELECT_SQL, proposals, selected

RECORD = "video_id long, frame long, timestamp_sec double, detections array<struct<event_id:long,bbox:array<double>,confidence:double>>"


def frame_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each frame with its boxes, in order."""
    d = tracked(spark, sf_dir)
    box = F.struct("event_id", F.array(*[F.col(c) for c in BOX]).alias("bbox"), r4(F.col("conf")).alias("confidence"))
    return d.groupBy("video_id", "frame").agg(F.array_sort(F.collect_list(box)).alias("detections")).select("video_id", "frame", r4(F.col("frame") / FPS, 3).alias("timestamp_sec"), "detections")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Flat rows of records in JSON: a record that is no JSON fails the job; frames without boxes give no rows."""
    r = spark.read.schema(RECORD).option("mode", "FAILFAST").json(path)
    return r.filter(F.size("detections") > 0).select("video_id", "frame", F.col("timestamp_sec").alias("t"), F.inline("detections"))


@query(f"WITH {TRACKED_SQL} SELECT video_id, frame, event_id, round(frame / {FPS}, 3) AS t, x1, y1, x2, y2, round(conf, 4) AS confidence FROM tracked")
def detection_records_read_back(spark, sf_dir):
    """Frame records written as JSON lines and read again as flat rows."""
    path = new_path(spark)
    frame_records(spark, sf_dir).write.json(path)
    d = read_records(spark, path)
    return d.select("video_id", "frame", "event_id", "t", *[F.col("bbox")[i].alias(c) for i, c in enumerate(BOX)], "confidence")


@query(f"WITH {TRACKED_SQL} SELECT video_id, CASE WHEN video_id % 2 = 0 THEN 'tracked' ELSE 'detections' END AS part, count(*) AS detections, CAST(sum(frame) AS BIGINT) AS frames FROM tracked GROUP BY 1, 2")
def wrapped_documents(spark, sf_dir):
    """Documents of a video that hold its rows as tracked or as detections: the first of the two that is there."""
    d = tracked(spark, sf_dir).select("video_id", F.struct("frame", "event_id").alias("r"))
    rows = d.groupBy("video_id").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    even = F.col("video_id") % 2 == 0
    doc = rows.select(F.to_json(F.struct("video_id", F.when(even, F.col("rows")).alias("tracked"), F.when(~even, F.col("rows")).alias("detections"))).alias("value"))
    path = new_path(spark)
    doc.write.text(path)
    one = "array<struct<frame:long,event_id:long>>"
    back = spark.read.schema(f"video_id long, tracked {one}, detections {one}").json(path)
    x = back.select("video_id", F.when(F.col("tracked").isNotNull(), "tracked").otherwise("detections").alias("part"), F.inline(F.coalesce("tracked", "detections")))
    return x.groupBy("video_id", "part").agg(F.count(F.lit(1)).alias("detections"), F.sum("frame").alias("frames"))


@query(f"""WITH {TRACK_SQL} SELECT video_id, printf('bevt_%04d\ttrack=%d\t%.3f-%.3f\tpeak=%.4f\tavg=%.4f\tframes=%d-%d', num, track_id, round(start_time, 3), round(end_time, 3), round(peak, 4), round(mean, 4), start_frame, end_frame) AS line FROM tnum WHERE tier = 'auto'""")
def audit_log(spark, sf_dir):
    """Tab-separated lines of automatically accepted events, written as text by video and read again."""
    e = track_events(spark, sf_dir).filter("tier = 'auto'")
    line = F.format_string("bevt_%04d\ttrack=%d\t%.3f-%.3f\tpeak=%.4f\tavg=%.4f\tframes=%d-%d", "num", "track_id", r4(F.col("start_time"), 3), r4(F.col("end_time"), 3), r4(F.col("peak")), r4(F.col("mean")), "start_frame", "end_frame")
    path = new_path(spark)
    e.select("video_id", line.alias("value")).write.partitionBy("video_id").text(path)
    return spark.read.text(path).select(F.col("video_id").cast("long").alias("video_id"), F.col("value").alias("line"))


@query(f"WITH {TRACK_SQL} SELECT video_id, num AS event, track_id, round(start_time, 3) AS start_time, round(end_time, 3) AS end_time, round(peak, 4) AS peak_confidence, round(mean, 4) AS avg_confidence, n AS detection_count, count(*) OVER (PARTITION BY video_id) AS listed FROM tnum WHERE tier = 'low_conf'")
def low_conf_listing(spark, sf_dir):
    """Low-confidence events of each video as one document with their count, read again."""
    e = track_events(spark, sf_dir).filter("tier = 'low_conf'")
    rows = e.select("video_id", F.col("num").alias("event"), "track_id", r4(F.col("start_time"), 3).alias("start_time"), r4(F.col("end_time"), 3).alias("end_time"), r4(F.col("peak")).alias("peak_confidence"), r4(F.col("mean")).alias("avg_confidence"), F.col("n").alias("detection_count"))
    path = new_path(spark)
    sinks.document(rows, {"threshold": "< 0.75 peak_confidence"}, "events", ["video_id"]).write.text(path)
    inner = "event long, track_id long, start_time double, end_time double, peak_confidence double, avg_confidence double, detection_count long"
    fields = ",".join(f"{x.split()[0]}:{x.split()[1]}" for x in inner.split(", "))
    back = spark.read.schema(f"video_id long, threshold string, events array<struct<{fields}>>").json(path)
    return back.select("video_id", F.size("events").cast("long").alias("listed"), F.inline("events"))


@query(f"WITH {TRACK_SQL} SELECT video_id, num AS event, tier FROM tnum")
def published_events(spark, sf_dir):
    """Events published twice under one name: readers see the last version that is complete."""
    e = track_events(spark, sf_dir).select("video_id", F.col("num").alias("event"), "tier")
    root = new_path(spark)
    sinks.publish(e.limit(3), root)
    sinks.publish(e, root)
    return sinks.published(spark, root)


@query(f"""WITH {SELECT_SQL} SELECT t.video_id, count(*) AS behavior_event_count, count(*) FILTER (tier = 'auto') AS auto_count, count(*) FILTER (tier = 'review') AS review_count, count(*) FILTER (tier = 'low_conf') AS low_conf_count, any_value(p) AS proposal_count, any_value(r) AS render_frames FROM tnum t JOIN (SELECT video_id, count(*) AS p FROM prop GROUP BY 1) USING (video_id) JOIN (SELECT video_id, count(DISTINCT f) AS r FROM chosen GROUP BY 1) USING (video_id) GROUP BY 1""")
def run_report(spark, sf_dir):
    """What a run made of each video."""
    n = lambda t: F.count_if(F.col("tier") == t)
    e = track_events(spark, sf_dir).groupBy("video_id").agg(F.count(F.lit(1)).alias("behavior_event_count"), n("auto").alias("auto_count"), n("review").alias("review_count"), n("low_conf").alias("low_conf_count"))
    p = proposals(spark, sf_dir).groupBy("video_id").agg(F.count(F.lit(1)).alias("proposal_count"))
    r = selected(spark, sf_dir).select("video_id", "f").distinct().groupBy("video_id").agg(F.count(F.lit(1)).alias("render_frames"))
    return e.join(p, "video_id").join(r, "video_id")


@query(f"""WITH {TRACK_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY num) AS k, count(*) OVER (PARTITION BY video_id) AS c FROM tnum)
SELECT video_id, k AS line_number, CASE WHEN k <= 12 THEN printf('| %d | %d-%d | %.3f |', k, start_frame, end_frame, round(end_time - start_time, 3)) ELSE printf('| ... %d more |', c - 12) END AS line FROM r WHERE k <= 12 OR k = 13""")
def report_table(spark, sf_dir):
    """A report's table of each video: its first 12 events and how many more there are (a top-12 report)."""
    e = track_events(spark, sf_dir)
    c = e.groupBy("video_id").agg(F.count(F.lit(1)).alias("c"))
    d = e.filter("num <= 13").join(c, "video_id")
    row = F.format_string("| %d | %d-%d | %.3f |", "num", "start_frame", "end_frame", r4(F.col("end_time") - F.col("start_time"), 3))
    return d.select("video_id", F.col("num").alias("line_number"), F.when(F.col("num") <= 12, row).otherwise(F.format_string("| ... %d more |", F.col("c") - 12)).alias("line"))


@query(f"""WITH {TRACKED_SQL}, v AS (SELECT DISTINCT video_id FROM tracked) SELECT video_id, CASE WHEN video_id % 3 = 0 THEN 30.0 WHEN video_id % 3 = 1 THEN 25.0 ELSE 60.0 END AS fps, CASE WHEN video_id % 3 = 2 THEN 3 ELSE 5 END AS detect_interval, 'clip_' || video_id || '_a' AS stem FROM v""")
def header_values(spark, sf_dir):
    """Settings of each video from two headers: the last one that has a value, zero counting as none, else a default; safe names."""
    from ..functions import scalars as s

    v = tracked(spark, sf_dir).select("video_id").distinct()
    k = F.col("video_id") % 3
    summary = v.select("video_id", F.when(k == 1, 25.0).when(k == 2, 24.0).otherwise(0.0).alias("fps"), F.lit(None).cast("int").alias("detect_interval"))
    preview = v.select("video_id", F.when(k == 2, 60.0).alias("fps"), F.when(k == 2, 3).alias("detect_interval"))
    d = summary.join(preview.select("video_id", F.col("fps").alias("f2"), F.col("detect_interval").alias("i2")), "video_id")
    name = F.concat(F.lit("clip:"), F.col("video_id").cast("string"), F.lit("?a"))
    return d.select("video_id", s.falsy(F.coalesce("f2", "fps"), 30.0).alias("fps"), F.coalesce("i2", "detect_interval", F.lit(5)).alias("detect_interval"), s.safe_stem(name).alias("stem"))


@query()
def discovered_files(spark, sf_dir):
    """Parquet files below the input, whatever their depth, in order (no SQL: it depends on the folder)."""
    return readers.discover(spark, sf_dir, ("parquet",)).select("name", "length")
