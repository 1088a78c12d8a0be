"""Playback: the plain render map, times of contact sheets, slices of a timeline, and the parameters of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import presets
from ..sources.shared import dealt
from ..sources.tracked import FPS, table, videos
from .behavior import TRACK_SQL, track_chunks, track_events
from .registry import BOX, query, r4
from .timeline import _TIMELINE_SQL, VALUES, spread, timeline_rows, written_out

# ---------------------------------------------------------------- plain render map

EXTEND = 3
_PLAIN_SQL = f"""{TRACK_SQL}, rw AS (SELECT video_id, vl, track_id, chunk, frame, {", ".join(BOX)}, lead(frame) OVER w AS nf, row_number() OVER w AS rn, {", ".join(f"lead({c}) OVER w AS n{c}" for c in BOX)} FROM tchunk JOIN vmeta USING (video_id) WINDOW w AS (PARTITION BY track_id, chunk ORDER BY frame, event_id)),
bag AS (
    SELECT video_id, track_id, chunk, frame AS f, {", ".join(BOX)} FROM rw
    UNION ALL SELECT video_id, track_id, chunk, f, {", ".join(f"{c} + (n{c} - {c}) * ((f - frame) / CAST(nf - frame AS DOUBLE)) AS {c}" for c in BOX)} FROM (SELECT *, unnest(range(frame + 1, nf)) AS f FROM rw WHERE nf - frame > 1)
    UNION ALL SELECT video_id, track_id, chunk, f, {", ".join(BOX)} FROM (SELECT *, unnest(range(greatest(0, frame - {EXTEND}), frame)) AS f FROM rw WHERE rn = 1)
    UNION ALL SELECT video_id, track_id, chunk, f, {", ".join(BOX)} FROM (SELECT *, unnest(range(frame + 1, least(vl, frame + {EXTEND}) + 1)) AS f FROM rw WHERE nf IS NULL))"""


@query(f"WITH {_PLAIN_SQL} SELECT video_id, track_id, chunk, f AS frame, {', '.join(f'round({c} + 0.0000001, 1) AS {c}' for c in BOX)} FROM bag")
def plain_render_map(spark, sf_dir):
    """A bag of boxes by frame: every detection of every event, lines over all gaps, three frames held at both ends."""
    ends = videos(spark, sf_dir).select("video_id", (F.col("frames") - 1).alias("vl"))
    d = track_chunks(spark, sf_dir).select("video_id", "track_id", "chunk", "frame", "event_id", *VALUES).join(ends, "video_id")
    x = written_out(spread(d, ["track_id", "chunk"], 1 << 40, EXTEND), ["video_id", "track_id", "chunk"])
    return x.select("video_id", "track_id", "chunk", F.col("f").alias("frame"), *[r4(F.col(c) + 0.0000001, 1).alias(c) for c in BOX])


# ---------------------------------------------------------------- contact sheets

SHEET_FPS = 4.0
_STEP = 1.0 / max(SHEET_FPS, 0.1)
_SHEET_SQL = f"""{TRACK_SQL}, span AS (SELECT video_id, track_id, chunk, round(start_time, 3) AS s, round(end_time, 3) AS e FROM tnum),
steps AS (SELECT *, unnest(range(0, CASE WHEN e <= s THEN 1 ELSE CAST(floor((e - s + 0.000000001) / {_STEP}) AS BIGINT) + 1 END)) AS i FROM span),
grid AS (SELECT video_id, track_id, chunk, i AS idx, round(s + i * {_STEP}, 3) AS sec FROM steps
    UNION ALL SELECT video_id, track_id, chunk, max(i) + 1, any_value(e) FROM steps GROUP BY 1, 2, 3 HAVING any_value(e) > any_value(s) AND max(round(s + i * {_STEP}, 3)) < any_value(e) - 0.000000001)"""


def sheet_times(e: DataFrame, step: float = _STEP) -> DataFrame:
    """Rows (idx, sec) for each row with bounds s and e: every step from s on, and e itself if no step falls on it."""
    steps = F.when(F.col("e") <= F.col("s"), F.array(F.col("s"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("e") - F.col("s") + 1e-9) / step)), lambda i: F.round(F.col("s") + i * step, 3)))
    whole = F.when((F.col("e") > F.col("s")) & (F.element_at("_g", -1) < F.col("e") - 1e-9), F.concat("_g", F.array("e"))).otherwise(F.col("_g"))
    keep = [c for c in e.columns if c not in ("s", "e")]
    return e.withColumn("_g", steps).select(*keep, F.posexplode(whole).alias("idx", "sec"))


def nearest_point(times: DataFrame, points: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """Each time with the point of its keys nearest in t, the earlier one on ties: one shuffle, no pairs.

    Points of one instant are one, the first in order of frame and id. Times without points have a null point. rows:
    detections by which partitions are dealt.
    """
    p = points.groupBy(*keys, F.col("t").alias("sec")).agg(F.min(F.struct("frame", "event_id", "t")).alias("p"))
    both = times.withColumn("p", F.lit(None).cast(p.schema["p"].dataType)).unionByName(p, allowMissingColumns=True)
    both = both if rows is None else dealt(both, rows, *keys)
    # ranges: rows of one instant see each other; both grow as they run, where one to the end would start anew at each row
    so_far = lambda at: Window.partitionBy(*keys).orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before, after = F.last("p", True).over(so_far(F.asc("sec"))), F.last("p", True).over(so_far(F.desc("sec")))
    both = both.withColumn("b", before).withColumn("a", after).filter("idx is not null")
    first = F.col("a").isNull() | (F.abs(F.col("b.t") - F.col("sec")) <= F.abs(F.col("a.t") - F.col("sec")))
    return both.withColumn("p", F.when(F.col("b").isNull(), F.col("a")).when(first, F.col("b")).otherwise(F.col("a"))).drop("a", "b")


@query(f"WITH {_SHEET_SQL} SELECT g.video_id, g.track_id, g.chunk, idx, sec, arg_min(d.frame, (abs(d.t - sec), d.frame, d.event_id)) AS frame, arg_min(d.event_id, (abs(d.t - sec), d.frame, d.event_id)) AS detection FROM grid g JOIN tchunk d ON d.track_id = g.track_id AND d.chunk = g.chunk GROUP BY ALL")
def contact_sheet_times(spark, sf_dir):
    """Four times a second of each behaviour event, with the detection that is shown then."""
    e = track_events(spark, sf_dir).select("video_id", "track_id", "chunk", r4(F.col("start_time"), 3).alias("s"), r4(F.col("end_time"), 3).alias("e"))
    d = track_chunks(spark, sf_dir).select("track_id", "chunk", "t", "frame", "event_id")
    x = nearest_point(sheet_times(e), d, ["track_id", "chunk"], table(spark, sf_dir, "events").count())
    return x.select("video_id", "track_id", "chunk", F.col("idx").cast("long").alias("idx"), "sec", "p.frame", F.col("p.event_id").alias("detection"))


# ---------------------------------------------------------------- slices of a timeline

WINDOW_SEC = 5.0


@query(f"""WITH {_TIMELINE_SQL}, fc AS (SELECT video_id, f AS frame, round(f / {FPS}, 3) AS ts, count(*) AS n FROM tl1 GROUP BY 1, 2),
b AS (SELECT video_id, min(ts) AS first, least(max(ts), min(ts) + {WINDOW_SEC}) AS last FROM fc GROUP BY 1)
SELECT video_id, first AS window_start, round(last, 3) AS window_end, CAST(sum(n) AS BIGINT) AS entries, count(*) AS frames, CAST(sum(CASE WHEN ts BETWEEN first AND last THEN n ELSE 0 END) AS BIGINT) AS entries_in_window, max(n) AS most_boxes, arg_min(frame, (-n, frame)) AS fullest_frame FROM fc JOIN b USING (video_id) GROUP BY ALL""")
def timeline_slices(spark, sf_dir):
    """Each video's timeline: its first five seconds (both ends included) and its fullest frame.

    Rows are counted by frame first, so what the window over a video sees is bounded by the frames of a video.
    """
    rows = dealt(timeline_rows(spark, sf_dir).select("video_id", "f"), table(spark, sf_dir, "events").count(), "video_id")
    by_frame = rows.groupBy("video_id", F.col("f").alias("frame")).agg(F.count(F.lit(1)).alias("n")).withColumn("ts", r4(F.col("frame") / FPS, 3))
    w = Window.partitionBy("video_id")
    d = by_frame.withColumn("first", F.min("ts").over(w)).withColumn("last", F.least(F.max("ts").over(w), F.min("ts").over(w) + WINDOW_SEC))
    return d.groupBy("video_id", F.col("first").alias("window_start"), r4(F.col("last"), 3).alias("window_end")).agg(
        F.sum("n").alias("entries"), F.count(F.lit(1)).alias("frames"), F.sum(F.when(F.col("ts").between(F.col("first"), F.col("last")), F.col("n")).otherwise(0)).alias("entries_in_window"),
        F.max("n").alias("most_boxes"), F.min_by("frame", F.struct(-F.col("n"), F.col("frame"))).alias("fullest_frame"),
    )


# ---------------------------------------------------------------- parameters of runs


def _asked_sql(c: str, every: int, value: str) -> str:
    return f"CASE WHEN s_suppkey % {every} = 0 THEN {value} END AS a_{c}"


_PRESET_SQL = f"ps AS (SELECT * FROM (VALUES {', '.join(str((m, *(v[i] for v in presets.PRESETS.values()))) for i, m in enumerate(presets.MODES))}) v(mode, {', '.join(presets.PRESETS)}))"


@query(f"""WITH {_PRESET_SQL}, asked AS (SELECT s_suppkey AS run, ['legacy', 'preview', 'production', 'fast_review', 'privacy'][s_nationkey % 5 + 1] AS mode, {_asked_sql("interval", 3, "s_suppkey % 6")}, {_asked_sql("conf", 4, "0.5")}, {_asked_sql("review", 2, "s_suppkey % 4 = 0")}, {_asked_sql("scan", 7, "false")}, s_suppkey % 3 AS batch, s_suppkey % 11 AS divisor FROM supplier)
SELECT run, mode, {", ".join({"interval": "coalesce(a_interval, interval) AS interval", "conf": "CAST(coalesce(a_conf, conf) AS DOUBLE) AS conf", "expand": "CAST(expand AS DOUBLE) AS expand", "mask_review": "coalesce(a_review, false) OR mask_review AS mask_review", "edge_review_scan": "coalesce(a_scan, edge_review_scan) AS edge_review_scan"}.get(c, c) for c in presets.PRESETS)},
    greatest(1, CASE WHEN batch = 0 THEN 1 ELSE batch END) AS detect_batch, greatest(4, CASE WHEN divisor = 0 THEN 8 ELSE divisor END) AS mask_scale_divisor, 1 AS filter_threads FROM asked JOIN ps USING (mode)""")
def resolved_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs (a supplier is one) with their mode, some of which ask for values of their own."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").withColumn("mode", F.element_at(F.array(*[F.lit(m) for m in presets.MODES]), (F.col("s_nationkey") % 5 + 1).cast("int")))
    asked = {"interval": F.when(k % 3 == 0, k % 6), "conf": F.when(k % 4 == 0, 0.5), "mask_review": F.when(k % 2 == 0, k % 4 == 0), "edge_review_scan": F.when(k % 7 == 0, False), "detect_batch": k % 3, "mask_scale_divisor": k % 11}
    return s.select(k.alias("run"), "mode", *[c.alias(n) for n, c in presets.resolve(F.col("mode"), asked).items()])
