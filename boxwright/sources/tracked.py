"""Sources: the base fact table of tracked boxes, projected from the events table, and decisions from labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FPS, WIDTH, HEIGHT, INTERVAL = 30.0, 1920, 1080, 5
#: Tracks of a video.
VIDEO_TRACKS = 10
#: Microseconds of wall time for one second of video, and the first instant.
SECOND, EPOCH = 14_400_000_000, 1_704_067_200_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, track_id, t, frame, conf, x1, y1, x2, y2, video_id: one row for each detection."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "props", (F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH).alias("us"))
    k = F.get_json_object("props", "$.k").cast("int")
    x, y = (F.col("user_id") * 97) % 1600 + (F.col("event_id") * 31) % 160, (F.col("user_id") * 53) % 800 + (F.col("event_id") * 17) % 120
    return e.select(
        "event_id",
        F.col("user_id").alias("track_id"),
        (F.col("us") / F.lit(float(SECOND))).alias("t"),
        F.floor(F.col("us") * 30 / F.lit(float(SECOND))).alias("frame"),
        (0.2 + (F.round(F.col("value") * 100) % 100) * 0.008).alias("conf"),
        x.cast("double").alias("x1"),
        y.cast("double").alias("y1"),
        (x + 80 + k % 60).cast("double").alias("x2"),
        (y + 100 + k % 80).cast("double").alias("y2"),
        F.floor(F.col("user_id") / VIDEO_TRACKS).alias("video_id"),
    )


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, frames, fps, width, height) of each video: as long as its detections say."""
    d = tracked(spark, sf_dir).groupBy("video_id").agg((F.max("frame") + 1).alias("frames"))
    return d.withColumns({"fps": F.lit(FPS), "width": F.lit(WIDTH), "height": F.lit(HEIGHT)})


#: The same for the oracle; vmeta has the last frame of each video.
TRACKED_SQL = f"""tracked AS (
    SELECT event_id, user_id AS track_id, us / {float(SECOND)} AS t, CAST(floor(us * 30 / {float(SECOND)}) AS BIGINT) AS frame,
        0.2 + (round(value * 100) % 100) * 0.008 AS conf, CAST(x AS DOUBLE) AS x1, CAST(y AS DOUBLE) AS y1,
        CAST(x + 80 + k % 60 AS DOUBLE) AS x2, CAST(y + 100 + k % 80 AS DOUBLE) AS y2, user_id // {VIDEO_TRACKS} AS video_id
    FROM (SELECT *, epoch_us(ts) - {EPOCH} AS us, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
        (user_id * 97) % 1600 + (event_id * 31) % 160 AS x, (user_id * 53) % 800 + (event_id * 17) % 120 AS y FROM events)),
vmeta AS (SELECT video_id, max(frame) AS vl FROM tracked GROUP BY video_id)"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review decisions by proposal number, from labels: 0 rejected, 1 accepted (toxic: first half only)."""
    status = F.when(F.col("quality") == 0, "rejected").when(F.col("toxic") == 1, "first_half").otherwise("accepted")
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("proposal"), status.alias("status"))


#: Keys of a decision document that are no events (fixed values).
META = ("events", "summary", "video", "review_dir", "started_at", "updated_at", "total_review_events", "decided_count", "schema", "decision_unit", "review_timing")


def parse_decisions(raw: DataFrame, column: str = "json", prefixes: tuple[str, ...] = (), keep: list[str] | None = None) -> DataFrame:
    """Decision documents as rows (event_id, status, ranges) beside the columns of keep.

    A document is a map of statuses, a map of objects with status and ranges, or has a list of events. Ranges count if
    they hold two numbers, the second greater.
    """
    keep = keep or []
    entry = "struct<event_id:string,status:string,review_status:string,ranges:array<array<double>>,accepted_ranges:array<array<double>>>"
    listed = raw.select(*keep, F.explode(F.from_json(F.get_json_object(column, "$.events"), f"array<{entry}>")).alias("e"))
    listed = listed.select(*keep, "e.event_id", F.coalesce("e.status", "e.review_status").alias("status"), F.coalesce("e.ranges", "e.accepted_ranges").alias("ranges"))
    pairs = raw.filter(F.from_json(F.get_json_object(column, "$.events"), f"array<{entry}>").isNull()).select(*keep, F.explode(F.from_json(column, "map<string,string>")).alias("event_id", "value"))
    as_struct = F.from_json("value", entry)
    mapped = pairs.filter(~F.col("event_id").isin(*META)).select(*keep, "event_id", F.coalesce(as_struct["status"], F.col("value")).alias("status"), F.coalesce(as_struct["ranges"], as_struct["accepted_ranges"]).alias("ranges"))
    names = F.create_map(F.lit("confirmed_face"), F.lit("accepted"), F.lit("rejected_fp"), F.lit("rejected"))
    ranges = F.filter(F.coalesce("ranges", F.array().cast("array<array<double>>")), lambda r: (F.size(r) == 2) & (F.try_element_at(r, F.lit(2)) > F.try_element_at(r, F.lit(1))))
    rows = listed.unionByName(mapped).filter("event_id is not null and status is not null and status <> ''")
    rows = rows.select(*keep, "event_id", F.coalesce(F.try_element_at(names, F.col("status")), F.col("status")).alias("status"), F.transform(ranges, lambda r: F.struct(r[0].alias("start"), r[1].alias("end"))).alias("ranges"))
    if prefixes:
        rows = rows.filter(F.expr(" OR ".join(f"startswith(event_id, '{p}')" for p in prefixes)))
    return rows
