"""What of a video is rendered anew and what is copied: runs of frames, gaps, keyframes, plans, and checks of streams.

Work is by video; in a video, intervals are merged within buckets of frames first (coalesce_spread), so a long video is
more than one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import islands as isl
from ..operators import rangejoin, runs
from ..sources.shared import cut
from ..sources.tracked import FPS, table, videos
from .registry import query, r4
from .timeline import SELECT_SQL, selected

MERGE_FRAMES, SPREAD = round(1.0 * FPS), 600
THRESHOLDS = (0.0, 0.25, 0.5, 1.0, 2.0, 3.0, 5.0)

#: Keyframes of each video: one each 2.002 s and some more, from parts; the first comes late in some videos.
KEY_SQL = f"""keys AS (SELECT DISTINCT v.video_id, greatest(0, CAST(floor(t * {FPS} + 0.000001) AS BIGINT)) AS k FROM (SELECT video_id, i * 2.002 + video_id % 3 AS t FROM (SELECT video_id, unnest(range(0, CAST(floor((vl + 1) / {FPS} / 2.002) AS BIGINT) + 1)) AS i FROM (SELECT DISTINCT video_id FROM raw) JOIN vmeta USING (video_id)) UNION ALL SELECT p_partkey % 15, p_size * 3.3 FROM part WHERE p_partkey % 50 = 0) v JOIN (SELECT DISTINCT video_id FROM raw) r ON r.video_id = v.video_id JOIN vmeta m ON m.video_id = v.video_id WHERE t < (vl + 1) / {FPS} UNION SELECT video_id, 0 FROM (SELECT DISTINCT video_id FROM raw))"""
RAW_SQL = f"""{SELECT_SQL}, raw0 AS (SELECT DISTINCT video_id, f FROM chosen), raw1 AS (SELECT *, f - row_number() OVER (PARTITION BY video_id ORDER BY f) AS grp FROM raw0), raw AS (SELECT video_id, min(f) AS start_frame, max(f) AS end_frame FROM raw1 GROUP BY video_id, grp), {KEY_SQL}"""


def _merge_sql(src: str, gap: int, name: str, keys: str = "video_id") -> str:
    w = f"(PARTITION BY {keys} ORDER BY start_frame, end_frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""{name}0 AS (SELECT *, max(end_frame) OVER {w} AS before FROM {src}), {name}1 AS (SELECT *, sum(CASE WHEN start_frame - before - 1 <= {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY start_frame, end_frame ROWS UNBOUNDED PRECEDING) AS grp FROM {name}0),
{name} AS (SELECT {keys}, min(start_frame) AS start_frame, max(end_frame) AS end_frame FROM {name}1 GROUP BY {keys}, grp)"""


def _snap_sql(src: str, name: str) -> str:
    return f"""{name}s AS (SELECT i.video_id, (SELECT max(k) FROM keys WHERE keys.video_id = i.video_id AND k <= i.start_frame) AS start_frame, least(vl, coalesce((SELECT min(k) FROM keys WHERE keys.video_id = i.video_id AND k >= i.end_frame + 1), vl + 1) - 1) AS end_frame FROM {src} i JOIN vmeta m ON m.video_id = i.video_id), {_merge_sql(f"{name}s", 0, name)}"""


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, frames), written once."""
    return cut(videos(spark, sf_dir).select("video_id", "frames"))


def keyframes(spark: SparkSession, sf_dir: str, some: DataFrame, frames: DataFrame) -> DataFrame:
    """(video_id, k) of some videos: frames of the keyframes' times, as far as the video goes; frame 0 always is one."""
    long = some.join(frames, "video_id")
    even = long.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("frames") / FPS / 2.002)))).select("video_id", "frames", (F.col("i") * 2.002 + F.col("video_id") % 3).alias("t"))
    more = table(spark, sf_dir, "part").filter("p_partkey % 50 = 0").select((F.col("p_partkey") % 15).alias("video_id"), (F.col("p_size") * 3.3).alias("t")).join(long, "video_id").select("video_id", "frames", "t")
    k = F.greatest(F.lit(0).cast("long"), F.floor(F.col("t") * FPS + 1e-6))
    return even.unionByName(more).filter(F.col("t") < F.col("frames") / FPS).select("video_id", k.alias("k")).unionByName(some.withColumn("k", F.lit(0).cast("long"))).distinct()


def raw_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of selected frames, written once: merging reads its input more than once."""
    return cut(isl.runs(selected(spark, sf_dir), ["video_id"], "f"))


def merged(d: DataFrame, gap: int) -> DataFrame:
    return cut(isl.coalesce_spread(d, ["video_id"], "start_frame", "end_frame", gap + 1, SPREAD))


def snapped(d: DataFrame, keys: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Intervals grown to the keyframe at or before their start and to the last frame before one behind their end, merged.

    Behind the last keyframe they go to the video's end, frames (video_id, frames); without it they end as they did.
    """
    d = d.withColumn("after", F.col("end_frame") + 1)
    d = rangejoin.asof(d, keys.withColumn("lo", F.col("k")), ["video_id"], "start_frame", "k", "lo")
    d = rangejoin.asof(d, keys.withColumn("hi", F.col("k")), ["video_id"], "after", "k", "hi", forward=True)
    last = F.coalesce(F.col("hi") - 1, "end_frame")
    if frames is not None:
        d = d.join(frames, "video_id")
        last = F.least(F.col("frames") - 1, F.coalesce("hi", "frames") - 1)
    return merged(cut(d.select("video_id", F.coalesce("lo", F.lit(0)).alias("start_frame"), last.alias("end_frame"))), 0)


@query(f"WITH {RAW_SQL} SELECT video_id, start_frame, end_frame FROM raw")
def render_runs(spark, sf_dir):
    return raw_intervals(spark, sf_dir)


@query(f"WITH {RAW_SQL}, {_merge_sql('raw', MERGE_FRAMES, 'mi')}, {_snap_sql('mi', 'ki')} SELECT * FROM ki")
def keyframe_intervals(spark, sf_dir):
    return _snapped_intervals(spark, sf_dir, lengths(spark, sf_dir))


def _snapped_intervals(spark: SparkSession, sf_dir: str, frames: DataFrame) -> DataFrame:
    raw = raw_intervals(spark, sf_dir)
    return snapped(merged(raw, MERGE_FRAMES), keyframes(spark, sf_dir, raw.select("video_id").distinct(), frames), frames)


PLAN_SQL = f"""{RAW_SQL}, {_merge_sql("raw", MERGE_FRAMES, "mi")}, {_snap_sql("mi", "ki")}, plan AS (SELECT * FROM (SELECT video_id, 'render' AS type, start_frame, end_frame FROM ki
    UNION ALL SELECT video_id, 'copy', coalesce(lag(end_frame) OVER (PARTITION BY video_id ORDER BY start_frame) + 1, 0), start_frame - 1 FROM ki UNION ALL SELECT video_id, 'copy', max(end_frame) + 1, any_value(vl) FROM ki JOIN vmeta USING (video_id) GROUP BY video_id) WHERE start_frame <= end_frame)"""


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = lengths(spark, sf_dir)
    return isl.complement(cut(_snapped_intervals(spark, sf_dir, frames).join(frames, "video_id")), ["video_id"], F.col("frames"))


@query(f"WITH {PLAN_SQL} SELECT * FROM plan")
def video_plan(spark, sf_dir):
    """Segments of each video, to be rendered or copied, without gap or overlap."""
    return plan(spark, sf_dir)


@query(f"WITH {PLAN_SQL} SELECT video_id, type, greatest(start_frame, 1000) AS start_frame, least(end_frame, 2999) AS end_frame, greatest(start_frame, 1000) - 1000 AS local_start FROM plan WHERE greatest(start_frame, 1000) <= least(end_frame, 2999)")
def cropped_plan(spark, sf_dir):
    """The plan within frames [1000, 3000), and where its segments begin there."""
    a, z = F.greatest("start_frame", F.lit(1000)), F.least("end_frame", F.lit(2999))
    return plan(spark, sf_dir).filter(a <= z).select("video_id", "type", a.alias("start_frame"), z.alias("end_frame"), (a - 1000).alias("local_start"))


@query(f"""WITH {RAW_SQL}, {_merge_sql("raw", MERGE_FRAMES, "mi")}, {_snap_sql("mi", "ki")}, tr AS (SELECT f, video_id FROM raw0), pl AS (SELECT video_id, count(*) AS render_segment_count FROM ki GROUP BY 1), kc AS (SELECT video_id, count(*) AS keyframe_count FROM keys GROUP BY 1),
r AS (SELECT video_id, count(*) AS raw_interval_count, CAST(sum(end_frame - start_frame + 1) AS BIGINT) AS raw_frames FROM raw GROUP BY 1), m AS (SELECT video_id, count(*) AS merged_interval_count, CAST(sum(end_frame - start_frame + 1) AS BIGINT) AS merged_frames FROM mi GROUP BY 1), k AS (SELECT video_id, count(*) AS keyframe_interval_count, CAST(sum(end_frame - start_frame + 1) AS BIGINT) AS keyframe_frames FROM ki GROUP BY 1)
SELECT video_id, keyframe_count, raw_interval_count, raw_frames, round(raw_frames / CAST(vl + 1 AS DOUBLE), 4) AS raw_coverage, merged_interval_count, merged_frames, round(merged_frames / CAST(vl + 1 AS DOUBLE), 4) AS merged_coverage, keyframe_interval_count, keyframe_frames, round(keyframe_frames / CAST(vl + 1 AS DOUBLE), 4) AS keyframe_coverage, render_segment_count FROM kc JOIN r USING (video_id) JOIN m USING (video_id) JOIN k USING (video_id) JOIN pl USING (video_id) JOIN vmeta USING (video_id)""")
def plan_summary(spark, sf_dir):
    """Intervals, frames and share of the video: as selected, merged, and snapped to keyframes."""
    raw = raw_intervals(spark, sf_dir)
    frames = lengths(spark, sf_dir)
    keys = cut(keyframes(spark, sf_dir, raw.select("video_id").distinct(), frames))
    mi = merged(raw, MERGE_FRAMES)
    ki = snapped(mi, keys, frames)

    def measure(d, name):
        n = F.sum(F.col("end_frame") - F.col("start_frame") + 1)
        return d.groupBy("video_id").agg(F.count(F.lit(1)).alias(f"{name}_interval_count"), n.alias(f"{name}_frames")).join(frames, "video_id").withColumn(f"{name}_coverage", r4(F.col(f"{name}_frames") / F.col("frames"))).drop("frames")

    d = keys.groupBy("video_id").agg(F.count(F.lit(1)).alias("keyframe_count"))
    for x, name in ((raw, "raw"), (mi, "merged"), (ki, "keyframe")):
        d = d.join(measure(x, name), "video_id")
    return d.withColumn("render_segment_count", F.col("keyframe_interval_count"))


def _sweep_sql() -> str:
    parts, rows = [], []
    for i, t in enumerate(THRESHOLDS):
        parts.append(f"{_merge_sql('raw', round(t * FPS), f'm{i}')}, {_snap_sql(f'm{i}', f'k{i}')}")
        rows.append(f"SELECT a.video_id, CAST({t} AS DOUBLE) AS merge_gap_sec, n AS merged_interval_count, c AS merged_coverage, kn AS keyframe_interval_count, kc AS keyframe_coverage FROM (SELECT video_id, count(*) AS n, round(sum(end_frame - start_frame + 1) / CAST(any_value(vl) + 1 AS DOUBLE), 4) AS c FROM m{i} JOIN vmeta USING (video_id) GROUP BY 1) a JOIN (SELECT video_id, count(*) AS kn, round(sum(end_frame - start_frame + 1) / CAST(any_value(vl) + 1 AS DOUBLE), 4) AS kc FROM k{i} JOIN vmeta USING (video_id) GROUP BY 1) b USING (video_id)")
    return f"WITH {RAW_SQL}, {', '.join(parts)} {' UNION ALL '.join(rows)}"


@query(_sweep_sql())
def coverage_sensitivity(spark, sf_dir):
    """How much is rendered under each of seven gaps, merged and snapped; all thresholds in one pass, each its own key."""
    raw = raw_intervals(spark, sf_dir)
    frames = lengths(spark, sf_dir)
    keys = keyframes(spark, sf_dir, raw.select("video_id").distinct(), frames)
    each = F.explode(F.array(*[F.lit(i) for i in range(len(THRESHOLDS))])).alias("i")
    # a threshold is a key beside the video; starts are moved back by the gap to merge, and forth again
    gaps = F.element_at(F.array(*[F.lit(round(t * FPS)) for t in THRESHOLDS]), F.col("i") + 1)
    d = cut(raw.select("*", each).withColumn("start_frame", F.col("start_frame") - gaps).withColumn("video_id", F.struct("video_id", "i")))
    m = isl.coalesce_spread(d.drop("i"), ["video_id"], "start_frame", "end_frame", 1, SPREAD).select("video_id", (F.col("start_frame") + F.element_at(F.array(*[F.lit(round(t * FPS)) for t in THRESHOLDS]), F.col("video_id.i") + 1)).alias("start_frame"), "end_frame")
    m = cut(m)
    times = lambda d: d.withColumn("video_id", F.explode(F.array(*[F.struct("video_id", F.lit(i).alias("i")) for i in range(len(THRESHOLDS))])))
    of_key = cut(times(frames))
    k = snapped(m, times(keys), of_key)
    measure = lambda d, name: d.join(of_key, "video_id").groupBy("video_id").agg(F.count(F.lit(1)).alias(f"{name}_interval_count"), r4(F.sum(F.col("end_frame") - F.col("start_frame") + 1) / F.first("frames")).alias(f"{name}_coverage"))
    out = measure(m, "merged").join(measure(k, "keyframe"), "video_id")
    return out.select("video_id.video_id", F.element_at(F.array(*[F.lit(t) for t in THRESHOLDS]), F.col("video_id.i") + 1).alias("merge_gap_sec"), "merged_interval_count", "merged_coverage", "keyframe_interval_count", "keyframe_coverage")


# ---------------------------------------------------------------- streams

#: Packets of a stream are the lines of orders of a part's remainder: some streams have one duration only.
PACKET_SQL = f"packets AS (SELECT l_partkey % 40 AS stream, l_orderkey * 8 + l_linenumber AS pts, l_orderkey, CASE WHEN l_partkey % 40 < 25 THEN round(1 / {FPS}, 9) ELSE round(1 / {FPS} + (l_orderkey % 2) * 0.01, 9) END AS duration FROM lineitem)"


@query(f"""WITH {PACKET_SQL}, o AS (SELECT *, pts > lag(pts) OVER (PARTITION BY stream ORDER BY pts) AS up FROM packets)
SELECT stream, count(*) AS packet_count, count(DISTINCT duration) AS unique_duration_count, coalesce(bool_and(up), true) AS pts_monotonic, count(DISTINCT duration) = 1 AND abs(min(duration) - 1 / {FPS}) <= 1 / {FPS} * 0.02 AND coalesce(bool_and(up), true) AS is_cfr_likely FROM o GROUP BY stream""")
def constant_rate_streams(spark, sf_dir):
    """Streams with one packet duration near a frame's, and strictly rising times."""
    li = table(spark, sf_dir, "lineitem")
    stream = F.col("l_partkey") % 40
    d = li.select(stream.alias("stream"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pts"), F.round(F.when(stream < 25, F.lit(1 / FPS)).otherwise(1 / FPS + (F.col("l_orderkey") % 2) * 0.01), 9).alias("duration"))
    d = d.withColumn("up", F.col("pts") > F.lag("pts").over(Window.partitionBy("stream").orderBy("pts")))
    d = d.groupBy("stream").agg(F.count(F.lit(1)).alias("packet_count"), F.min("duration").alias("a"), F.max("duration").alias("z"), F.count_distinct("duration").alias("unique_duration_count"), F.coalesce(F.bool_and("up"), F.lit(True)).alias("pts_monotonic"))
    return d.select("stream", "packet_count", "unique_duration_count", "pts_monotonic", ((F.col("unique_duration_count") == 1) & (F.abs(F.col("a") - 1 / FPS) <= 1 / FPS * 0.02) & F.col("pts_monotonic")).alias("is_cfr_likely"))


@query(f"""WITH st AS (SELECT s_suppkey AS stream, CASE WHEN s_suppkey % 3 = 0 THEN '30000/1001' WHEN s_suppkey % 3 = 1 THEN '30/1' ELSE '25' END AS rate, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_acctbal END AS audio, 1000 + s_suppkey * 37 AS frames FROM supplier), p AS (SELECT *, CASE rate WHEN '30000/1001' THEN 30000 / 1001.0 WHEN '30/1' THEN 30.0 ELSE 25.0 END AS fps FROM st)
SELECT stream, round(fps, 6) AS fps, CASE WHEN audio IS NULL THEN 'no_audio' ELSE 'copy_source_once' END AS final_audio_mode, CASE WHEN audio IS NULL THEN frames ELSE least(frames, CAST(round(greatest(0.0, abs(audio) / 100) * fps) AS BIGINT)) END AS expected_mux_frames, printf('%.6f', frames / fps) AS duration FROM p""")
def mux_expectations(spark, sf_dir):
    """Frame rates from text, what becomes of the audio, and how many frames are left when it ends first."""
    d = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("stream"), F.when(F.col("s_suppkey") % 3 == 0, "30000/1001").when(F.col("s_suppkey") % 3 == 1, "30/1").otherwise("25").alias("rate"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal")).alias("audio"), (1000 + F.col("s_suppkey") * 37).alias("frames"))
    d = d.withColumn("fps", s.frame_rate(F.col("rate")))
    by_audio = F.round(F.greatest(F.lit(0.0), F.abs("audio") / 100) * F.col("fps")).cast("long")  # halves up, as SQL
    return d.select("stream", F.round("fps", 6).alias("fps"), F.when(F.col("audio").isNull(), "no_audio").otherwise("copy_source_once").alias("final_audio_mode"), F.when(F.col("audio").isNull(), F.col("frames")).otherwise(F.least("frames", by_audio)).alias("expected_mux_frames"), F.format_string("%.6f", F.col("frames") / F.col("fps")).alias("duration"))


@query("""WITH r AS (SELECT o_custkey AS id, round((o_orderkey * 131 % 4000) / 100.0, 3) AS a, round((o_orderkey * 131 % 4000) / 100.0 + (o_orderkey % 7 - 1) * 0.7, 3) AS z FROM orders), g AS (SELECT * FROM r WHERE z > a),
b AS (SELECT *, max(z) OVER (PARTITION BY id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g), n AS (SELECT *, sum(CASE WHEN round(a - before, 6) <= 0.001 THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS grp FROM b)
SELECT id, min(a) AS start_time, max(z) AS end_time FROM n GROUP BY id, grp""")
def merged_time_ranges(spark, sf_dir):
    """Time ranges of an owner merged if they are at most a millisecond apart; empty ones are dropped."""
    a = (F.col("o_orderkey") * 131 % 4000) / 100.0
    d = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), r4(a, 3).alias("start_time"), r4(a + (F.col("o_orderkey") % 7 - 1) * 0.7, 3).alias("end_time")).filter("end_time > start_time")
    w = Window.partitionBy("id").orderBy("start_time", "end_time")
    d = d.withColumn("before", F.max("end_time").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("new", F.when(F.round(F.col("start_time") - F.col("before"), 6) <= 0.001, 0).otherwise(1)).withColumn("grp", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy("id", "grp").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time")).drop("grp")


#: Timing tables: a run (count, delta) for each line of a stream's orders, sync samples from orders; some lie behind the end.
TIMESCALE = 30_000
TIMING_SQL = f"""tr AS (SELECT l_partkey % 40 AS stream, l_orderkey * 8 + l_linenumber AS pos, min(CAST(l_quantity AS BIGINT)) AS n, min(CASE WHEN l_partkey % 40 < 25 OR l_orderkey % 9 > 0 THEN 1001 ELSE 1001 + l_linenumber END) AS delta FROM lineitem GROUP BY 1, 2),
tp AS (SELECT *, sum(n) OVER w - n AS n0, sum(n * delta) OVER w - n * delta AS t0 FROM tr WINDOW w AS (PARTITION BY stream ORDER BY pos)),
sy AS (SELECT DISTINCT o_custkey % 40 AS stream, o_orderkey * 3 + 1 AS sample FROM orders)"""


def timing_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Runs (stream, at, n, delta) and sync samples (stream, sample), samples from 1."""
    li = table(spark, sf_dir, "lineitem")
    stream = F.col("l_partkey") % 40
    delta = F.when((stream < 25) | (F.col("l_orderkey") % 9 > 0), 1001).otherwise(1001 + F.col("l_linenumber"))
    r = li.groupBy(stream.alias("stream"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at")).agg(F.min(F.col("l_quantity").cast("long")).alias("n"), F.min(delta.cast("long")).alias("delta"))
    sync = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("stream"), (F.col("o_orderkey") * 3 + 1).alias("sample")).distinct()
    return cut(runs.prefixed(r, ["stream"], "at", "n", "delta")), sync


@query(f"WITH {TIMING_SQL} SELECT y.stream, sample, CAST(t0 + (sample - 1 - n0) * delta AS BIGINT) AS ticks, (t0 + (sample - 1 - n0) * delta) / {float(TIMESCALE)} AS seconds FROM sy y JOIN tp r ON y.stream = r.stream AND sample > n0 AND sample <= n0 + n")
def keyframe_decode_times(spark, sf_dir):
    """When each sync sample is decoded, from the run lengths of the timing table; samples behind its end have no time."""
    table_, sync = timing_tables(spark, sf_dir)
    d = runs.at_elements(sync, table_, ["stream"], "sample", "n", "delta")
    return d.select("stream", "sample", F.col("total").alias("ticks"), (F.col("total") / F.lit(float(TIMESCALE))).alias("seconds"))


@query(f"""WITH {TIMING_SQL}, k AS (SELECT y.stream, count(*) AS keyframe_count, max((t0 + (sample - 1 - n0) * delta) / {float(TIMESCALE)}) AS last_keyframe FROM sy y JOIN tp r ON y.stream = r.stream AND sample > n0 AND sample <= n0 + n GROUP BY 1),
e AS (SELECT stream, CAST(sum(n) AS BIGINT) AS sample_count, count(*) AS entry_count, array_to_string(list_sort(list(DISTINCT delta)), ',') AS sample_deltas, count(DISTINCT delta) = 1 AS constant_rate FROM tr GROUP BY 1)
SELECT e.*, coalesce(keyframe_count, 0) AS keyframe_count, last_keyframe FROM e LEFT JOIN k USING (stream)""")
def timing_evidence(spark, sf_dir):
    """What a stream's timing table says: samples, entries, deltas, whether its rate is constant, its keyframes."""
    table_, sync = timing_tables(spark, sf_dir)
    e = table_.groupBy("stream").agg(F.sum("n").alias("sample_count"), F.count(F.lit(1)).alias("entry_count"), F.array_join(F.array_sort(F.collect_set("delta")), ",").alias("sample_deltas"), (F.count_distinct("delta") == 1).alias("constant_rate"))
    d = runs.at_elements(sync, table_, ["stream"], "sample", "n", "delta")
    k = d.groupBy("stream").agg(F.count(F.lit(1)).alias("keyframe_count"), (F.max("total") / F.lit(float(TIMESCALE))).alias("last_keyframe"))
    return e.join(k, "stream", "left").fillna(0, ["keyframe_count"])
