"""Evaluation of events against a ground truth, by clips of a video.

The ground truth comes from another table than the predictions: an order is an interval of the video of its customer.
Predictions are behaviour events of tracks or presence events; stitching_comparison holds the two stitching
variants against silver truth. All work is by video and clip, so pairs meet in a clip only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import matching
from ..sources.shared import cut, dealt
from ..sources.tracked import table
from .behavior import SEG_EVENT_SQL, TRACK_SQL, presence_events, stitched_events, track_events
from .identity import VARIANTS, variant_members
from .registry import part_id, query, r4

STEP, IOU, COVERAGE, REVIEW_SECONDS = 0.1, 0.30, 0.25, 30.0


#: Clips that a video is meant to have, the least and the greatest length of one, and customers of a video.
TARGET, SHORTEST, LONGEST, CUSTOMERS = 30, 10.0, 45.0, 100
#: Seconds over which the orders' intervals are strewn.
STREWN = 180

TRUTH_SQL = f"""truth0 AS (SELECT o_orderkey AS gt_id, o_custkey // {CUSTOMERS} AS video_id, (o_orderkey * 7919 % {STREWN * 100}) / 100.0 AS start_time, (o_orderkey * 7919 % {STREWN * 100}) / 100.0 + (o_orderkey * 37 % 420 - 20) / 100.0 AS end_time, o_orderstatus <> 'O' AS should_mask FROM orders),
gt AS (SELECT * FROM truth0 WHERE should_mask AND end_time > start_time)"""
CLIPS_SQL = f"""ends AS (SELECT video_id, max(end_time) AS dur, greatest({SHORTEST}, least({LONGEST}, max(end_time) / {TARGET})) AS len FROM (SELECT video_id, end_time FROM gt UNION ALL SELECT video_id, end_time FROM pred0) GROUP BY 1),
clips AS (SELECT video_id, c AS clip, c * len AS c0, least(dur, (c + 1) * len) AS c1 FROM (SELECT *, unnest(range(0, CAST(ceil((dur - 0.01) / len) AS BIGINT))) AS c FROM ends))"""


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("o_orderkey") * 7919 % (STREWN * 100)) / 100.0
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("gt_id"), F.floor(F.col("o_custkey") / CUSTOMERS).alias("video_id"), start.alias("start_time"), (start + (F.col("o_orderkey") * 37 % 420 - 20) / 100.0).alias("end_time"), (F.col("o_orderstatus") != "O").alias("should_mask"))


@query(f"WITH {TRUTH_SQL} SELECT printf('gt_%04d', gt_id) AS gt_event_id, video_id, round(start_time, 3) AS start_time, round(end_time, 3) AS end_time, should_mask, 'face_presence' AS label FROM gt")
def ground_truth_events(spark, sf_dir):
    """Ground truth in its schema, with defaults filled in."""
    return usable(truth(spark, sf_dir)).select(F.format_string("gt_%04d", "gt_id").alias("gt_event_id"), "video_id", r4(F.col("start_time"), 3).alias("start_time"), r4(F.col("end_time"), 3).alias("end_time"), "should_mask", F.lit("face_presence").alias("label"))


def _variants_sql() -> str:
    pred = lambda name, src, ids: f"SELECT '{name}' AS variant, video_id, {ids} AS pred_id, tier, round(start_time, 3) AS start_time, round(end_time, 3) AS end_time FROM {src}"
    # both event families share the CTEs of pieces and segments
    more = SEG_EVENT_SQL[SEG_EVENT_SQL.index("se0_r AS") :]
    return f"""{TRACK_SQL}, {more}, pred0 AS ({pred("track_behavior", "tnum", "track_id * 1048576 + chunk")} UNION ALL {pred("presence", "se", "track_id * 1048576 + seg")}),
pred AS (SELECT * FROM pred0 WHERE end_time > start_time AND tier <> 'low_conf')"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variant, video_id, pred_id, tier, start_time, end_time) of two event families, logged ones too."""
    cols = lambda d, name, part: d.select(F.lit(name).alias("variant"), "video_id", part_id("track_id", part).alias("pred_id"), "tier", r4(F.col("start_time"), 3).alias("start_time"), r4(F.col("end_time"), 3).alias("end_time"))
    return cols(track_events(spark, sf_dir), "track_behavior", "chunk").unionByName(cols(presence_events(spark, sf_dir), "presence", "seg"))


def usable(rows: DataFrame) -> DataFrame:
    """Intervals that count: to be masked, and of a length."""
    return rows.filter("should_mask and end_time > start_time")


class Case:
    """Ground truth and predictions, each written once, that an evaluation holds against each other.

    A video is as long as its last event of either, and its clips are tiles of a thirtieth of that, within limits.
    """

    def __init__(self, gt: DataFrame, pred: DataFrame):
        self.gt, self.pred = cut(usable(gt)), cut(pred)
        dur = F.max("end_time")
        self.rows = self.gt.count() + self.pred.count()
        last = self.gt.select("video_id", "end_time").unionByName(self.pred.select("video_id", "end_time"))
        self.ends = cut(last.groupBy("video_id").agg(dur.alias("dur"), F.greatest(F.lit(SHORTEST), F.least(F.lit(LONGEST), dur / TARGET)).alias("len")))


def families(spark: SparkSession, sf_dir: str) -> Case:
    return Case(truth(spark, sf_dir), predictions(spark, sf_dir))


def _last_clip():
    return F.ceil((F.col("dur") - 0.01) / F.col("len")) - 1


def _bounds() -> dict:
    return {"c0": F.col("clip") * F.col("len"), "c1": F.least("dur", (F.col("clip") + 1) * F.col("len"))}


def clips(case: Case) -> DataFrame:
    """(video_id, clip, c0, c1): tiles of each video, the last one clipped."""
    long = case.ends.filter(_last_clip() >= 0).withColumn("clip", F.explode(F.sequence(F.lit(0).cast("long"), _last_clip())))
    return long.withColumns(_bounds()).select("video_id", "clip", "c0", "c1")


def by_clip(rows: DataFrame, case: Case) -> DataFrame:
    """Rows once for each clip of their video that they overlap (open intervals): an event names its clips itself."""
    at = lambda t: F.greatest(F.lit(0).cast("long"), F.least(_last_clip(), F.floor(F.col(t) / F.col("len"))))
    d = rows.join(case.ends, "video_id").filter(_last_clip() >= 0).withColumn("clip", F.explode(F.sequence(at("start_time"), at("end_time"))))
    return d.withColumns(_bounds()).drop("dur", "len").filter("end_time > c0 and start_time < c1")


_IN_CLIP = "clips.video_id = {0}.video_id AND end_time > c0 AND start_time < c1"
CLIP_SQL = f"""{_variants_sql()}, {TRUTH_SQL}, {CLIPS_SQL}, gc AS (SELECT gt.*, clip, c0, c1 FROM gt JOIN clips ON {_IN_CLIP.format("gt")}), pc AS (SELECT pred.*, clip, c0, c1 FROM pred JOIN clips ON {_IN_CLIP.format("pred")}), rc AS (SELECT pred0.*, clip FROM pred0 JOIN clips ON {_IN_CLIP.format("pred0")}),
pair AS (SELECT variant, video_id, clip, gt_id, pred_id, greatest(0.0, least(gc.end_time, pc.end_time) - greatest(gc.start_time, pc.start_time)) AS inter, gc.end_time - gc.start_time AS gt_len, greatest(gc.end_time, pc.end_time) - least(gc.start_time, pc.start_time) AS hull FROM gc JOIN pc USING (video_id, clip))"""


def pairs(spark: SparkSession, sf_dir: str, case: Case | None = None) -> DataFrame:
    """Ground truth and predictions that share a clip of a video, with their common length.

    Both are dealt by clip into partitions for each SHARE of rows: few bytes make many pairs.
    """
    case = case or families(spark, sf_dir)
    gt = by_clip(case.gt, case).select("video_id", "clip", "gt_id", F.col("start_time").alias("g0"), F.col("end_time").alias("g1"))
    pred = by_clip(counted(case.pred), case).select("variant", "video_id", "clip", "pred_id", F.col("start_time").alias("p0"), F.col("end_time").alias("p1"))
    d = dealt(gt, case.rows, "video_id", "clip").join(dealt(pred, case.rows, "video_id", "clip"), ["video_id", "clip"])
    return d.select("variant", "video_id", "clip", "gt_id", "pred_id", F.greatest(F.lit(0.0), F.least("g1", "p1") - F.greatest("g0", "p0")).alias("inter"), (F.col("g1") - F.col("g0")).alias("gt_len"), (F.greatest("g1", "p1") - F.least("g0", "p0")).alias("hull"))


def counted(pred: DataFrame) -> DataFrame:
    return pred.filter("end_time > start_time and tier <> 'low_conf'")


@query(f"WITH {CLIP_SQL} SELECT video_id, clip, count(*) AS gt_events, round(sum(least(end_time, c1) - greatest(start_time, c0)), 3) AS overlap_sec FROM gc GROUP BY 1, 2")
def ground_truth_by_clip(spark, sf_dir):
    case = families(spark, sf_dir)
    return by_clip(case.gt, case).groupBy("video_id", "clip").agg(F.count(F.lit(1)).alias("gt_events"), r4(F.sum(F.least("end_time", "c1") - F.greatest("start_time", "c0")), 3).alias("overlap_sec"))


@query(f"WITH {CLIP_SQL} SELECT variant, video_id, clip, gt_id, pred_id, round(inter / hull, 4) AS iou FROM pair WHERE inter / hull >= {IOU}")
def iou_pairs(spark, sf_dir):
    """All pairs of a clip whose intervals' IoU is 0.30 at least."""
    return pairs(spark, sf_dir).filter(F.col("inter") / F.col("hull") >= IOU).select("variant", "video_id", "clip", "gt_id", "pred_id", r4(F.col("inter") / F.col("hull")).alias("iou"))


def _matchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pairs(spark, sf_dir).withColumn("iou", F.col("inter") / F.col("hull")).filter(F.col("iou") >= IOU)
    return d.select("variant", "video_id", "clip", "gt_id", "pred_id", "iou")


_CLIP = ["variant", "video_id", "clip"]


@query()
def clip_matches(spark, sf_dir):
    """Pairs of a clip by falling IoU, each side once, in rounds of joins (no SQL: tested against a loop)."""
    return matching.dominant_pairs(_matchable(spark, sf_dir), _CLIP, "gt_id", "pred_id", "iou").withColumn("iou", r4(F.col("iou")))


@query(f"""WITH {CLIP_SQL}, m AS (SELECT *, inter / hull AS iou FROM pair WHERE inter / hull >= {IOU}),
r AS (SELECT *, row_number() OVER (PARTITION BY variant, video_id, clip, gt_id ORDER BY iou DESC, pred_id) AS a, row_number() OVER (PARTITION BY variant, video_id, clip, pred_id ORDER BY iou DESC, gt_id) AS b FROM m)
SELECT variant, video_id, clip, gt_id, pred_id, round(iou, 4) AS iou FROM r WHERE a = 1 AND b = 1""")
def clip_matches_first_round(spark, sf_dir):
    """What the first round of clip_matches takes: pairs that are the best of both their sides."""
    return matching.dominant(_matchable(spark, sf_dir), _CLIP, "gt_id", "pred_id", "iou").withColumn("iou", r4(F.col("iou")))


@query(f"""WITH {CLIP_SQL} SELECT video_id, printf('clip_%03d', clip + 1) AS clip_id, round(c0, 3) AS start_time, round(c1, 3) AS end_time, round(c1 - c0, 3) AS duration_sec, 'segment_' || (clip + 1) AS label FROM clips""")
def uniform_clips(spark, sf_dir):
    """Every video's clips, as long as its events say."""
    c = clips(families(spark, sf_dir))
    return c.select("video_id", F.format_string("clip_%03d", F.col("clip") + 1).alias("clip_id"), r4(F.col("c0"), 3).alias("start_time"), r4(F.col("c1"), 3).alias("end_time"), r4(F.col("c1") - F.col("c0"), 3).alias("duration_sec"), F.concat(F.lit("segment_"), (F.col("clip") + 1).cast("string")).alias("label"))


def violations(events: DataFrame, clips: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(video_id, part, item, violation): all rules of a ground truth that its rows break, row by row.

    events (video_id, gt_id, start_time, end_time, should_mask), clips (video_id, clip, c0, c1), docs (video_id,
    duration_sec, clips_ref), where it is given, one for each document. A time that is missing counts as 0.
    """
    row = lambda d, part, item, text: d.select("video_id", F.lit(part).alias("part"), item.alias("item"), F.lit(text).alias("violation"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    masked = F.coalesce("should_mask", F.lit(True))
    out = row(events.filter("start_time is null or end_time is null"), "events", F.col("gt_id"), "missing start_time/end_time")
    out = out.unionByName(row(events.filter(masked & (zero("end_time") <= zero("start_time"))), "events", F.col("gt_id"), "invalid interval"))
    out = out.unionByName(row(clips.filter("clip is null"), "clips", F.col("clip"), "missing clip_id"))
    out = out.unionByName(row(clips.filter(zero("c1") <= zero("c0")), "clips", F.col("clip"), "invalid interval"))
    if docs is not None:
        none = F.lit(None).cast("long")
        there = events.select("video_id").unionByName(clips.select("video_id")).distinct()
        bare = docs.filter("coalesce(duration_sec, 0.0) = 0.0 and coalesce(clips_ref, '') = ''").join(there, "video_id", "left_anti")
        out = out.unionByName(row(docs.filter("video_id is null"), "document", none, "missing video path"))
        out = out.unionByName(row(bare.filter("video_id is not null"), "document", none, "ground truth must include events, clips[], duration_sec, or clips_ref"))
    return out


@query(f"""WITH {CLIP_SQL} SELECT video_id, 'events' AS part, CAST(gt_id AS BIGINT) AS item, 'invalid interval' AS violation FROM truth0 WHERE should_mask AND end_time <= start_time
UNION ALL SELECT video_id, 'clips', clip, 'invalid interval' FROM clips WHERE c1 <= c0""")
def ground_truth_violations(spark, sf_dir):
    """All violations of the ground truth's rules (a loader refuses the document if there is one)."""
    return violations(truth(spark, sf_dir), clips(families(spark, sf_dir)))


_COVER = f"inter / gt_len >= {COVERAGE}"
MERGE_SQL = f"""{CLIP_SQL}, om AS (SELECT variant, video_id, clip, pred_id AS id, count(*) AS n, max(inter / hull) AS best FROM pair WHERE {_COVER} GROUP BY 1, 2, 3, 4 HAVING count(*) > 1), os AS (SELECT variant, video_id, clip, gt_id AS id, count(*) AS n, max(inter / hull) AS best FROM pair WHERE {_COVER} GROUP BY 1, 2, 3, 4 HAVING count(*) > 1)"""


def errors(d: DataFrame) -> DataFrame:
    big = d.filter(F.col("inter") / F.col("gt_len") >= COVERAGE).withColumn("iou", F.col("inter") / F.col("hull"))
    one = lambda kind, key: big.groupBy("variant", "video_id", "clip", F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max("iou").alias("best")).filter("n > 1").withColumn("kind", F.lit(kind))
    return one("over_merge", "pred_id").unionByName(one("over_split", "gt_id"))


@query(f"WITH {MERGE_SQL} SELECT variant, video_id, clip, 'over_merge' AS kind, id, n, round(best, 4) AS best_iou FROM om UNION ALL SELECT variant, video_id, clip, 'over_split', id, n, round(best, 4) FROM os")
def merge_split_errors(spark, sf_dir):
    """Predictions that cover a quarter of more than one ground truth, and ground truth that more than one prediction covers so."""
    return errors(pairs(spark, sf_dir)).select("variant", "video_id", "clip", "kind", "id", "n", r4(F.col("best")).alias("best_iou"))


def _steps_sql(src: str, keys: str) -> str:
    return f"SELECT DISTINCT {keys}, unnest(range(greatest(CAST(ceil(round(start_time * 10, 6)) AS BIGINT), CAST(round(c0 * 10) AS BIGINT)), least(CAST(floor(round(end_time * 10, 6)) AS BIGINT), CAST(round(c1 * 10) AS BIGINT)) + 1)) AS step FROM {src}"


MASK_SQL = f"""{MERGE_SQL}, vv AS (SELECT DISTINCT variant, video_id FROM pred0), gs AS ({_steps_sql("gc", "video_id, clip")}), ps AS ({_steps_sql("pc", "variant, video_id, clip")}),
gv AS (SELECT variant, video_id, clip, step, 1 AS g FROM gs JOIN vv USING (video_id)), m0 AS (SELECT variant, video_id, clip, count(g) AS gt_n, count(p) AS pred_n, count(*) FILTER (p IS NOT NULL AND g IS NULL) AS false_n, count(*) FILTER (g IS NOT NULL AND p IS NULL) AS miss_n FROM gv FULL JOIN (SELECT *, 1 AS p FROM ps) USING (variant, video_id, clip, step) GROUP BY 1, 2, 3),
grid AS (SELECT variant, video_id, clip, CAST(round((c1 - c0) * 10) AS BIGINT) + 1 AS samples FROM vv JOIN clips USING (video_id)),
masks AS (SELECT variant, video_id, clip, samples, coalesce(gt_n, 0) AS gt_n, coalesce(pred_n, 0) AS pred_n, coalesce(false_n, 0) AS false_n, coalesce(miss_n, 0) AS miss_n FROM grid LEFT JOIN m0 USING (variant, video_id, clip))"""


def masks(spark: SparkSession, sf_dir: str, case: Case | None = None) -> DataFrame:
    """Counts of sampled tenths of a second by clip, both ends of a clip among them: masked by truth, prediction, one only."""
    case = case or families(spark, sf_dir)

    def steps(rows, keys, name):
        lo = F.greatest(F.ceil(F.round(F.col("start_time") * 10, 6)), F.round(F.col("c0") * 10).cast("long"))
        hi = F.least(F.floor(F.round(F.col("end_time") * 10, 6)), F.round(F.col("c1") * 10).cast("long"))
        d = by_clip(rows, case).select(*keys, "clip", lo.alias("lo"), hi.alias("hi")).filter("hi >= lo")
        # of spans with one start the longest holds the others; a clip's steps are no more than its tenths of a second
        longest = dealt(d, case.rows, "video_id", "clip").groupBy(*keys, "clip", "lo").agg(F.max("hi").alias("hi"))
        spans = longest.groupBy(*keys, "clip").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
        return spans.select(*keys, "clip", F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["lo"], x["hi"])))).alias(name))

    every = case.pred
    vv = every.select("variant", "video_id").distinct()
    g, p = steps(case.gt, ["video_id"], "g"), steps(counted(every), ["variant", "video_id"], "p")
    grid = vv.join(clips(case), "video_id").select("variant", "video_id", "clip", (F.round((F.col("c1") - F.col("c0")) * 10).cast("long") + 1).alias("samples"))
    d = grid.join(g, ["video_id", "clip"], "left").join(p, ["variant", "video_id", "clip"], "left")
    none, n = F.array().cast("array<bigint>"), lambda a, name: F.size(a).cast("long").alias(name)
    d = d.withColumns({"g": F.coalesce("g", none), "p": F.coalesce("p", none)})
    return d.select("variant", "video_id", "clip", "samples", n("g", "gt_n"), n("p", "pred_n"), n(F.array_except("p", "g"), "false_n"), n(F.array_except("g", "p"), "miss_n"))


@query(f"""WITH {MASK_SQL} SELECT variant, video_id, clip, samples, round(false_n * {STEP}, 3) AS false_mask_sec, round(miss_n * {STEP}, 3) AS miss_mask_sec, round(gt_n * {STEP}, 3) AS gt_mask_sec, round(pred_n * {STEP}, 3) AS pred_mask_sec, round(false_n / CAST(samples AS DOUBLE), 4) AS false_mask_ratio, CASE WHEN gt_n > 0 THEN round(miss_n / CAST(gt_n AS DOUBLE), 4) ELSE 0.0 END AS miss_mask_ratio,
    CASE WHEN gt_n + pred_n > 0 THEN round((pred_n - false_n) / CAST(greatest(1, gt_n + pred_n - false_n) AS DOUBLE), 4) ELSE 0.0 END AS mask_iou_ref, CASE WHEN gt_n + false_n > 0 THEN round((pred_n - false_n) / CAST(gt_n + false_n AS DOUBLE), 4) ELSE 0.0 END AS mask_iou FROM masks""")
def clip_mask_errors(spark, sf_dir):
    """Seconds masked wrongly or missed in each clip, and ratios; mask_iou_ref divides as the reference does, mask_iou by the union."""
    n = lambda c: F.col(c)
    sec = lambda c: r4(F.col(c) * STEP, 3)
    hit = n("pred_n") - n("false_n")
    return masks(spark, sf_dir).select(
        "variant", "video_id", "clip", "samples", sec("false_n").alias("false_mask_sec"), sec("miss_n").alias("miss_mask_sec"), sec("gt_n").alias("gt_mask_sec"), sec("pred_n").alias("pred_mask_sec"), r4(n("false_n") / n("samples")).alias("false_mask_ratio"), F.when(n("gt_n") > 0, r4(n("miss_n") / n("gt_n"))).otherwise(0.0).alias("miss_mask_ratio"),
        F.when(n("gt_n") + n("pred_n") > 0, r4(hit / F.greatest(F.lit(1), n("gt_n") + hit))).otherwise(0.0).alias("mask_iou_ref"), F.when(n("gt_n") + n("false_n") > 0, r4(hit / (n("gt_n") + n("false_n")))).otherwise(0.0).alias("mask_iou"),
    )


OBJECTIVE_SQL = f"""{MASK_SQL}, cost AS (SELECT variant, video_id, clip, count(*) AS events, count(*) FILTER (tier = 'review') AS review_events, count(*) FILTER (tier = 'auto') AS auto_events FROM rc GROUP BY 1, 2, 3), ec AS (SELECT variant, video_id, clip, count(*) FILTER (kind = 'm') AS merges, count(*) FILTER (kind = 's') AS splits FROM (SELECT variant, video_id, clip, 'm' AS kind FROM om UNION ALL SELECT variant, video_id, clip, 's' FROM os) GROUP BY 1, 2, 3),
obj AS (SELECT variant, video_id, clip, round(false_n * {STEP}, 3) AS false_sec, round(miss_n * {STEP}, 3) AS miss_sec, coalesce(merges, 0) AS merges, coalesce(splits, 0) AS splits, coalesce(events, 0) AS events, coalesce(review_events, 0) AS review_events, round(coalesce(review_events, 0) * {REVIEW_SECONDS} / 60, 2) AS minutes FROM masks LEFT JOIN cost USING (variant, video_id, clip) LEFT JOIN ec USING (variant, video_id, clip))"""


def objectives(spark: SparkSession, sf_dir: str, case: Case | None = None) -> DataFrame:
    keys = ["variant", "video_id", "clip"]
    case = case or families(spark, sf_dir)
    cost = by_clip(case.pred, case).groupBy(*keys).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("tier") == "review").alias("review_events"))
    err = errors(pairs(spark, sf_dir, case)).groupBy(*keys).agg(F.count_if(F.col("kind") == "over_merge").alias("merges"), F.count_if(F.col("kind") == "over_split").alias("splits"))
    d = masks(spark, sf_dir, case).join(cost, keys, "left").join(err, keys, "left").fillna(0, ["events", "review_events", "merges", "splits"])
    return d.select(*keys, r4(F.col("false_n") * STEP, 3).alias("false_sec"), r4(F.col("miss_n") * STEP, 3).alias("miss_sec"), "merges", "splits", "events", "review_events", r4(F.col("review_events") * REVIEW_SECONDS / 60, 2).alias("minutes"))


@query(f"WITH {OBJECTIVE_SQL} SELECT *, CASE WHEN events > 0 THEN round(review_events / CAST(events AS DOUBLE), 4) ELSE 0.0 END AS review_ratio, round(false_sec + miss_sec + 2 * minutes, 3) AS objective_score FROM obj")
def clip_objectives(spark, sf_dir):
    """What each clip costs under each variant: wrong and missed seconds, and twice the minutes of review."""
    d = objectives(spark, sf_dir)
    return d.withColumn("review_ratio", F.when(F.col("events") > 0, r4(F.col("review_events") / F.col("events"))).otherwise(0.0)).withColumn("objective_score", r4(F.col("false_sec") + F.col("miss_sec") + 2 * F.col("minutes"), 3))


_ROLL = "SELECT variant, count(*) AS clip_count, round(sum(false_sec), 3) AS total_false_mask_sec, round(sum(miss_sec), 3) AS total_miss_mask_sec, CAST(sum(merges) AS DOUBLE) AS total_over_merge, CAST(sum(splits) AS DOUBLE) AS total_over_split, CAST(sum(events) AS DOUBLE) AS total_events, CAST(sum(review_events) AS DOUBLE) AS total_review_events, round(sum(minutes), 2) AS total_minutes, round(sum(round(false_sec + miss_sec + 2 * minutes, 3)) / count(*), 3) AS mean_objective_score FROM obj GROUP BY variant"
_TOTALS = ("total_false_mask_sec", "total_miss_mask_sec", "total_over_merge", "total_over_split", "total_events", "total_review_events", "total_minutes", "mean_objective_score")


@query(f"""WITH {OBJECTIVE_SQL}, roll AS ({_ROLL}) SELECT variant, clip_count, {", ".join(_TOTALS)} FROM roll UNION ALL SELECT 'delta', b.clip_count - a.clip_count, {", ".join(f"round(b.{c} - a.{c}, 3)" for c in _TOTALS)} FROM roll a, roll b WHERE a.variant = 'presence' AND b.variant = 'track_behavior'
UNION ALL SELECT 'recommended: ' || CASE WHEN b.mean_objective_score <= a.mean_objective_score THEN 'track_behavior' ELSE 'presence' END, NULL, {", ".join("NULL" for _ in _TOTALS)} FROM roll a, roll b WHERE a.variant = 'presence' AND b.variant = 'track_behavior'""")
def variant_comparison(spark, sf_dir):
    """Totals of both event families over all clips, their difference, and the one with the lower mean objective."""
    return compared(objectives(spark, sf_dir), "presence", "track_behavior")


def compared(costs: DataFrame, first: str, second: str) -> DataFrame:
    """Totals of two variants over all clips, second less first, and the one with the lower mean (second if equal).

    costs are written once, and the differences come from two rows.
    """
    d = costs.withColumn("score", r4(F.col("false_sec") + F.col("miss_sec") + 2 * F.col("minutes"), 3))
    n = F.count(F.lit(1))
    roll = cut(d.groupBy("variant").agg(n.alias("clip_count"), *[r4(F.sum(c), k).cast("double").alias(t) for c, t, k in zip(("false_sec", "miss_sec", "merges", "splits", "events", "review_events", "minutes"), _TOTALS, (3, 3, 0, 0, 0, 0, 2), strict=False)], r4(F.sum("score") / n, 3).alias("mean_objective_score")))
    both = roll.groupBy().pivot("variant", [first, second]).agg(*[F.first(c).alias(c) for c in ("clip_count", *_TOTALS)])
    delta = both.select(F.lit("delta").alias("variant"), *[F.round(F.col(f"{second}_{c}") - F.col(f"{first}_{c}"), 3).alias(c) for c in ("clip_count", *_TOTALS)])
    best = F.when(F.col(f"{second}_mean_objective_score") <= F.col(f"{first}_mean_objective_score"), second).otherwise(first)
    pick = both.select(F.concat(F.lit("recommended: "), best).alias("variant"), F.lit(None).cast("long").alias("clip_count"), *[F.lit(None).cast("double").alias(c) for c in _TOTALS])
    return roll.unionByName(delta).unionByName(pick)


# ---------------------------------------------------------------- the stitching variants


def silver_truth(events: DataFrame) -> DataFrame:
    """Ground truth made of events (video_id, event_id, start_time, end_time): nobody has looked at it."""
    return events.select(F.coalesce("event_id", F.format_string("gt_%04d", F.row_number().over(Window.partitionBy("video_id").orderBy("start_time", "end_time")))).alias("gt_id"), "video_id", "start_time", "end_time", F.lit(True).alias("should_mask"), F.lit("face_presence").alias("label"))


@query(f"WITH {TRACK_SQL} SELECT printf('bevt_%04d', num) AS gt_event_id, video_id, round(start_time, 3) AS start_time, round(end_time, 3) AS end_time, true AS should_mask, 'face_presence' AS label, 'silver_bootstrap' AS provenance FROM tnum")
def silver_truth_events(spark, sf_dir):
    """Silver truth of the tracks' behaviour events, all tiers as the events document has them."""
    return _silver(spark, sf_dir).select(F.col("gt_id").alias("gt_event_id"), "video_id", "start_time", "end_time", "should_mask", "label", F.lit("silver_bootstrap").alias("provenance"))


def _silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = track_events(spark, sf_dir)
    return silver_truth(e.select("video_id", F.format_string("bevt_%04d", "num").alias("event_id"), r4(F.col("start_time"), 3).alias("start_time"), r4(F.col("end_time"), 3).alias("end_time")))


def stitched(spark: SparkSession, sf_dir: str) -> Case:
    """Silver truth and the behaviour events of both stitching variants."""
    e = stitched_events(spark, sf_dir, variant_members(spark, sf_dir))
    return Case(_silver(spark, sf_dir), e.select("variant", "video_id", F.col("num").alias("pred_id"), "tier", r4(F.col("start_time"), 3).alias("start_time"), r4(F.col("end_time"), 3).alias("end_time")))


@query()
def stitching_objectives(spark, sf_dir):
    """What each clip costs under each stitching variant, against silver truth (no SQL: tested against loops)."""
    return objectives(spark, sf_dir, stitched(spark, sf_dir))


@query()
def stitching_comparison(spark, sf_dir):
    """Totals of the greedy and the graph variant over all clips, their difference, and the recommended one.

    Both are stitched over one table of profiles, and their events are built in one plan keyed by variant (no SQL:
    tested against loops).
    """
    return compared(objectives(spark, sf_dir, stitched(spark, sf_dir)), *VARIANTS)
