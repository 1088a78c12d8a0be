"""Review: decision documents, reports, queues, bridges from low-confidence events to accepted ones, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import closure
from ..operators import islands as isl
from ..sources.shared import cut
from ..sources.tracked import FPS, HEIGHT, WIDTH, parse_decisions, table, tracked
from .behavior import TRACK_SQL, track_chunks, track_events
from .registry import BOX, part_id, query, r4
from .timeline import ACCEPTED, PROPOSAL_SQL, decide, proposals, review_reason

# ---------------------------------------------------------------- decisions and reports

EVENT_DEC_SQL = f"""{TRACK_SQL}, ed AS (SELECT tnum.*, CASE WHEN l.quality IS NULL THEN NULL WHEN l.quality = 0 THEN 'rejected' WHEN l.toxic = 1 THEN 'skipped' WHEN doc_id % 3 = 0 THEN 'accepted_ranges' ELSE 'accepted' END AS status FROM tnum LEFT JOIN labels l ON l.doc_id = (track_id * 31 + chunk * 7) % 1000)"""


def event_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Behaviour events with the status of their decision, null where there is none."""
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("_q"), "toxic")
    e = track_events(spark, sf_dir).withColumn("_doc", (F.col("track_id") * 31 + F.col("chunk") * 7) % 1000).join(lab, F.col("_doc") == F.col("doc_id"), "left")
    status = F.when(F.col("_q").isNull(), None).when(F.col("_q") == 0, "rejected").when(F.col("toxic") == 1, "skipped").when(F.col("doc_id") % 3 == 0, "accepted_ranges").otherwise("accepted")
    return e.withColumn("status", status).drop("_doc", "doc_id", "_q", "toxic")


_ACC = f"status IN {ACCEPTED}"


@query(f"""WITH {EVENT_DEC_SQL} SELECT video_id, count(*) AS total_events, count(*) FILTER ({_ACC}) AS accepted, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'skipped') AS skipped, count(*) - count(*) FILTER ({_ACC}) - count(*) FILTER (status = 'rejected') AS remaining,
    round(100.0 * count(*) FILTER ({_ACC}) / count(*), 1) AS accept_rate, round(100.0 * count(*) FILTER (status = 'rejected') / count(*), 1) AS reject_rate, round(100.0 * count(*) FILTER (status = 'skipped') / count(*), 1) AS skip_rate,
    round(avg(CAST(round(peak * 10000) AS BIGINT)) FILTER ({_ACC}) / 10000, 4) AS accepted_avg_peak, round(avg(CAST(round(peak * 10000) AS BIGINT)) FILTER (status = 'rejected') / 10000, 4) AS rejected_avg_peak, round(avg(CAST(round(dur * 1000) AS BIGINT)) FILTER ({_ACC}) / 1000, 4) AS accepted_avg_duration, round(avg(CAST(round(dur * 1000) AS BIGINT)) FILTER (status = 'rejected') / 1000, 4) AS rejected_avg_duration, round(avg(n) FILTER ({_ACC}), 4) AS accepted_avg_frames FROM ed GROUP BY 1""")
def review_statistics(spark, sf_dir):
    """The review report of each video: counts and rates by decision, and averages that skip what isn't there."""
    d = event_decisions(spark, sf_dir)
    s = F.coalesce("status", F.lit(""))
    acc, rej, n = s.isin(*ACCEPTED), s == "rejected", F.count(F.lit(1))
    rate = lambda c: r4(100.0 * F.count_if(c) / n, 1)
    whole = lambda c, k: F.round(F.col(c) * k).cast("long")
    avg = lambda c, k, cond: r4(F.avg(F.when(cond, whole(c, k))) / k)
    return d.groupBy("video_id").agg(
        n.alias("total_events"), F.count_if(acc).alias("accepted"), F.count_if(rej).alias("rejected"), F.count_if(s == "skipped").alias("skipped"), (n - F.count_if(acc) - F.count_if(rej)).alias("remaining"), rate(acc).alias("accept_rate"), rate(rej).alias("reject_rate"), rate(s == "skipped").alias("skip_rate"),
        avg("peak", 10000, acc).alias("accepted_avg_peak"), avg("peak", 10000, rej).alias("rejected_avg_peak"), avg("dur", 1000, acc).alias("accepted_avg_duration"), avg("dur", 1000, rej).alias("rejected_avg_duration"), r4(F.avg(F.when(acc, F.col("n")))).alias("accepted_avg_frames"),
    )


@query(f"""WITH {EVENT_DEC_SQL} SELECT v.video_id, q.quality, count(ed.n) AS events, count(*) FILTER ({_ACC}) AS accepted, count(*) FILTER (status = 'rejected') AS rejected FROM (SELECT DISTINCT video_id FROM ed) v CROSS JOIN (VALUES ('HIGH'), ('MEDIUM'), ('LOW')) q(quality) LEFT JOIN ed ON ed.video_id = v.video_id AND ed.quality = q.quality GROUP BY 1, 2""")
def quality_gate_crosstab(spark, sf_dir):
    """Events of each quality by decision, zeros filled in."""
    s, levels = F.coalesce("status", F.lit("")), ("HIGH", "MEDIUM", "LOW")
    of = lambda q, c: F.count_if((F.col("quality") == q) & c)
    d = event_decisions(spark, sf_dir).groupBy("video_id").agg(F.array(*[F.struct(F.lit(q).alias("quality"), of(q, F.lit(True)).alias("events"), of(q, s.isin(*ACCEPTED)).alias("accepted"), of(q, s == "rejected").alias("rejected")) for q in levels]).alias("r"))
    return d.select("video_id", F.inline("r"))


@query(f"""WITH {EVENT_DEC_SQL} SELECT video_id, count(*) AS event_count, count(*) FILTER (tier = 'review') AS review_event_count, count(*) FILTER (tier = 'auto') AS auto_event_count, count(*) FILTER (tier = 'low_conf') AS low_conf_event_count, round(count(*) FILTER (tier = 'review') * 30.0 / 60, 2) AS estimated_review_minutes, round(count(*) FILTER (tier = 'review') / CAST(count(*) AS DOUBLE), 4) AS review_ratio FROM ed GROUP BY 1""")
def review_cost_by_video(spark, sf_dir):
    n = lambda t: F.count_if(F.col("tier") == t)
    return track_events(spark, sf_dir).groupBy("video_id").agg(F.count(F.lit(1)).alias("event_count"), n("review").alias("review_event_count"), n("auto").alias("auto_event_count"), n("low_conf").alias("low_conf_event_count"), r4(n("review") * 30.0 / 60, 2).alias("estimated_review_minutes"), r4(n("review") / F.count(F.lit(1))).alias("review_ratio"))


@query(f"""WITH {EVENT_DEC_SQL}, t AS (SELECT video_id, count(*) AS total, count(*) FILTER ({_ACC} OR status = 'rejected') AS decided, CAST(sum(n) AS BIGINT) AS shown FROM ed GROUP BY 1)
SELECT video_id, decided, total, shown * 0.5 AS elapsed_sec, printf('%02d:%02d:%02d', CAST(round(shown * 0.5) AS BIGINT) // 3600, CAST(round(shown * 0.5) AS BIGINT) // 60 % 60, CAST(round(shown * 0.5) AS BIGINT) % 60) AS elapsed, CASE WHEN decided > 0 THEN CAST(round(shown * 500.0 / decided) AS BIGINT) ELSE 4000 END AS avg_decision_ms, decided >= total AS finished FROM t""")
def review_timing(spark, sf_dir):
    """Time spent (half a second for each detection shown) and per decision; 4000 ms where nothing is decided."""
    s = F.coalesce("status", F.lit(""))
    d = event_decisions(spark, sf_dir).groupBy("video_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(s.isin(*ACCEPTED, "rejected")).alias("decided"), F.sum("n").alias("shown"))
    sec = F.round(F.col("shown") * 0.5).cast("long")
    return d.select("video_id", "decided", "total", (F.col("shown") * 0.5).alias("elapsed_sec"), F.format_string("%02d:%02d:%02d", F.floor(sec / 3600), F.floor(sec / 60) % 60, sec % 60).alias("elapsed"), F.when(F.col("decided") > 0, F.round(F.col("shown") * 500.0 / F.col("decided")).cast("long")).otherwise(F.lit(4000).cast("long")).alias("avg_decision_ms"), (F.col("decided") >= F.col("total")).alias("finished"))


@query(f"""WITH {EVENT_DEC_SQL}, q AS (SELECT video_id, num - 1 AS idx, {_ACC} OR status = 'rejected' AS final, status FROM ed), n AS (SELECT video_id, count(*) AS n, count(*) // 2 AS start FROM q GROUP BY 1)
SELECT video_id, start, arg_min(idx, (idx - start + n) % n) AS next_pending, arg_min(idx, (start - idx + n) % n) AS previous_pending, count(*) FILTER (idx BETWEEN start - 8 AND start + 8) AS pending_in_view FROM q JOIN n USING (video_id) WHERE coalesce(final, false) = false GROUP BY 1, 2""")
def pending_navigation(spark, sf_dir):
    """From the middle of each queue: the next and the previous undecided event, wrapping round, and those within 8 of it."""
    s = F.coalesce("status", F.lit(""))
    q = event_decisions(spark, sf_dir).select("video_id", (F.col("num") - 1).cast("long").alias("idx"), s.isin(*ACCEPTED, "rejected").alias("final"))
    by_video = q.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.when(~F.col("final"), F.col("idx"))).alias("open"))
    by_video = by_video.withColumn("start", F.floor(F.col("n") / 2)).filter(F.size("open") > 0)
    near = lambda sign: F.array_min(F.transform("open", lambda i: F.struct(((sign * (i - F.col("start")) + F.col("n")) % F.col("n")).alias("d"), i.alias("i"))))["i"]
    return by_video.select("video_id", "start", near(1).alias("next_pending"), near(-1).alias("previous_pending"), F.size(F.filter("open", lambda i: i.between(F.col("start") - 8, F.col("start") + 8))).cast("long").alias("pending_in_view"))


@query(f"WITH {EVENT_DEC_SQL} SELECT video_id, num AS event, CASE WHEN status IS NULL THEN 0 ELSE 1 END AS turn FROM ed WHERE status IS NULL OR status = 'skipped'")
def review_queue(spark, sf_dir):
    """Events never decided first, then those skipped."""
    d = event_decisions(spark, sf_dir)
    never, skipped = d.filter("status is null").withColumn("turn", F.lit(0)), d.filter("status = 'skipped'").withColumn("turn", F.lit(1))
    return never.unionByName(skipped).select("video_id", F.col("num").alias("event"), "turn")


# ---------------------------------------------------------------- review pack, decisions in documents

@query(f"""WITH {PROPOSAL_SQL} SELECT video_id, proposal_id, CASE WHEN (tier = 'low_conf' AND (round(peak, 4) >= 0.70 OR (list_contains(hints, 'edge_clip') AND round(peak, 4) >= 0.60))) OR tier = 'review' THEN 'pending' ELSE 'suppressed' END AS queue, 'event_contact_sheet/' || proposal_id || '.jpg' AS contact_sheet FROM prop WHERE tier <> 'auto'""")
def review_pack(spark, sf_dir):
    """Proposals for review, and those that the filter keeps from it; each has entries, since it has detections."""
    p = proposals(spark, sf_dir).filter("tier <> 'auto'")
    queue = F.when(review_reason() == "low_conf_below_main_review_threshold", "suppressed").otherwise("pending")
    return p.select("video_id", "proposal_id", queue.alias("queue"), F.concat(F.lit("event_contact_sheet/"), "proposal_id", F.lit(".jpg")).alias("contact_sheet"))


def decision_documents(d: DataFrame) -> DataFrame:
    """(video_id, form, json): the decisions of a video as a map of statuses, a map of objects, or a list."""
    d = d.filter("status is not null").withColumn("id", F.format_string("bevt_%04d", "num"))
    ranges = F.array(F.array(F.lit(1.0), F.lit(1.5)), F.array(F.lit(3.0), F.lit(2.0)))
    form = F.col("video_id") % 3
    flat = F.struct("id", F.to_json(F.struct("status", ranges.alias("ranges"))).alias("obj"), "status")
    by_video = d.groupBy("video_id", form.alias("form")).agg(F.array_sort(F.collect_list(flat)).alias("m"))
    quote = lambda s: F.concat(F.lit('"'), s, F.lit('"'))
    legacy = lambda s: F.when(s == "accepted", "confirmed_face").when(s == "rejected", "rejected_fp").otherwise(s)
    pair = F.transform("m", lambda x: F.concat(quote(x["id"]), F.lit(":"), F.when(F.col("form") == 1, x["obj"]).otherwise(quote(x["status"]))))
    rows = F.transform("m", lambda x: F.concat(F.lit('{"event_id":'), quote(x["id"]), F.lit(',"status":'), quote(legacy(x["status"])), F.lit("}")))
    meta = F.lit('"schema":"mask_review_decisions.v2","decided_count":"1",')
    body = F.when(F.col("form") == 2, F.concat(F.lit('{"events":['), F.array_join(rows, ","), F.lit("]}"))).otherwise(F.concat(F.lit("{"), meta, F.array_join(pair, ","), F.lit("}")))
    return by_video.select("video_id", "form", body.alias("json"))


@query(f"""WITH {EVENT_DEC_SQL} SELECT video_id, printf('bevt_%04d', num) AS event_id, status, CASE WHEN video_id % 3 = 1 THEN 1 ELSE 0 END AS ranges FROM ed WHERE status IS NOT NULL""")
def decisions_read_back(spark, sf_dir):
    """Decisions written as documents of three forms and read again: renamed statuses, no meta keys, empty ranges dropped."""
    docs = cut(decision_documents(event_decisions(spark, sf_dir)))
    return parse_decisions(docs, keep=["video_id"], prefixes=("bevt_", "evt_", "mask_")).select("video_id", "event_id", "status", F.size("ranges").alias("ranges"))


@query(f"""WITH {EVENT_DEC_SQL}, o AS (SELECT video_id, num, status FROM ed WHERE status IS NOT NULL), n AS (SELECT video_id, num, 'accepted' AS status FROM ed WHERE num % 5 = 0 AND tier <> 'auto')
SELECT video_id, num AS event, status FROM n UNION ALL SELECT video_id, num, status FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.video_id = o.video_id AND n.num = o.num)""")
def decisions_upserted(spark, sf_dir):
    """Old decisions with new ones in their place, for events that are still pending and statuses that are valid."""
    from ..sources.sinks import upsert_decisions

    d = event_decisions(spark, sf_dir).withColumn("key", F.struct("video_id", "num"))
    old = d.filter("status is not null").select("key", "status")
    new = d.filter("num % 5 = 0").select("key", F.lit("accepted").alias("status")).unionByName(d.filter("num % 7 = 0").select("key", F.lit("unknown").alias("status")))
    return upsert_decisions(old, new, d.filter("tier <> 'auto'"), "key").select("key.video_id", F.col("key.num").alias("event"), "status")


# ---------------------------------------------------------------- low-confidence events

_BRIDGE_GAP = 1.0
BRIDGE_SQL = f"""{EVENT_DEC_SQL}, traj AS (SELECT track_id, chunk, t, frame, event_id, {", ".join(BOX)} FROM tchunk), ev AS (SELECT *, track_id * 1048576 + chunk AS id FROM ed WHERE coalesce(status, '') <> 'rejected' OR tier <> 'low_conf'),
pr AS (SELECT l.id AS a, o.id AS b, l.track_id AS lt, l.chunk AS lc, o.track_id AS bt, o.chunk AS bc, least(greatest((l.start_time + l.end_time) * 0.5, o.start_time), o.end_time) AS probe FROM ev l JOIN ev o ON l.video_id = o.video_id AND l.id <> o.id AND greatest(l.start_time - o.end_time, o.start_time - l.end_time, 0.0) <= {_BRIDGE_GAP}
    WHERE l.tier = 'low_conf' AND l.end_time - l.start_time <= 3.0 AND l.peak >= 0.35 AND (o.tier = 'low_conf' OR o.tier = 'auto' OR o.status IN {ACCEPTED})),
bx AS (SELECT a, b, {", ".join(f"arg_min(ta.{c}, (abs(ta.t - probe), ta.frame, ta.event_id)) AS l{c}" for c in BOX)} FROM pr JOIN traj ta ON ta.track_id = lt AND ta.chunk = lc GROUP BY a, b),
by2 AS (SELECT a, b, {", ".join(f"arg_min(tb.{c}, (abs(tb.t - probe), tb.frame, tb.event_id)) AS o{c}" for c in BOX)} FROM pr JOIN traj tb ON tb.track_id = bt AND tb.chunk = bc GROUP BY a, b),
ok AS (SELECT a, b FROM bx JOIN by2 USING (a, b) WHERE {g.iou_sql("l", "o")} >= 0.08 OR {g.center_ratio_sql("l", "o")} <= 0.85),
reach AS (SELECT id FROM ev WHERE tier = 'auto' OR status IN {ACCEPTED} UNION SELECT ok.a FROM ok JOIN reach ON ok.b = reach.id)"""


@query(f"WITH RECURSIVE {BRIDGE_SQL} SELECT ev.video_id, ev.track_id, ev.chunk FROM reach JOIN ev USING (id) WHERE ev.tier = 'low_conf'")
def bridged_low_conf_events(spark, sf_dir):
    """Low-confidence events that are accepted, or reach an accepted event over events that match in time and place.

    A pair matches by one probe time; each side's box there is its detection nearest in time. The closure goes on until
    nothing is added.
    """
    d = cut(event_decisions(spark, sf_dir).withColumn("id", part_id("track_id", "chunk")).filter("coalesce(status, '') <> 'rejected' or tier <> 'low_conf'"))
    accepted = (F.col("tier") == "auto") | F.coalesce(F.col("status").isin(*ACCEPTED), F.lit(False))
    side = lambda x, p: x.select("video_id", *[F.col(c).alias(f"{p}_{c}") for c in ("id", "track_id", "chunk", "start_time", "end_time")])
    low = side(d.filter("tier = 'low_conf' and end_time - start_time <= 3.0 and peak >= 0.35"), "a")
    other = side(d.filter(accepted | (F.col("tier") == "low_conf")), "b")
    # meet in tiles of ten seconds, once: in the tile where the later of the two starts (grown by the gap)
    tiles = lambda a, z: F.explode(F.sequence(F.floor(a / 10), F.floor(z / 10)))
    j = low.withColumn("tile", tiles(F.col("a_start_time") - _BRIDGE_GAP, F.col("a_end_time"))).join(other.withColumn("tile", tiles(F.col("b_start_time") - _BRIDGE_GAP, F.col("b_end_time"))), ["video_id", "tile"])
    j = j.filter((F.col("a_id") != F.col("b_id")) & (F.greatest(F.col("a_start_time") - F.col("b_end_time"), F.col("b_start_time") - F.col("a_end_time"), F.lit(0.0)) <= _BRIDGE_GAP)).drop("tile").distinct()
    j = cut(j.withColumn("probe", F.least(F.greatest((F.col("a_start_time") + F.col("a_end_time")) * 0.5, F.col("b_start_time")), F.col("b_end_time"))))
    boxes = track_chunks(spark, sf_dir).select("track_id", "chunk", "t", "frame", "event_id", F.struct(*BOX).alias("box"))

    def nearest(p):
        x = j.select("a_id", "b_id", "probe", F.col(f"{p}_track_id").alias("track_id"), F.col(f"{p}_chunk").alias("chunk")).join(boxes, ["track_id", "chunk"])
        return x.groupBy("a_id", "b_id").agg(F.min_by("box", F.struct(F.abs(F.col("t") - F.col("probe")), "frame", "event_id")).alias(p))

    both = nearest("a").join(nearest("b"), ["a_id", "b_id"]).select("a_id", "b_id", *[F.col(f"{p}.{c}").alias(p + c) for p in "ab" for c in BOX])
    ok = both.filter((g.iou(g.box("a"), g.box("b")) >= 0.08) | (g.center_ratio(g.box("a"), g.box("b")) <= 0.85))
    found = closure.reach(d.filter(accepted).select("id"), cut(ok.select(F.col("b_id").alias("a"), F.col("a_id").alias("b"))), both_ways=False)
    return d.filter("tier = 'low_conf'").join(found, "id", "left_semi").select("video_id", "track_id", "chunk")


_MID = "(start_time + end_time) * 0.5"
PROMOTE_SQL = f"""{EVENT_DEC_SQL}, mid AS (SELECT e.track_id, e.chunk, {", ".join(f"arg_min(d.{c}, (abs(d.t - (e.start_time + e.end_time) * 0.5), d.frame, d.event_id)) AS {c}" for c in BOX)} FROM ed e JOIN tchunk d ON d.track_id = e.track_id AND d.chunk = e.chunk GROUP BY 1, 2),
mc AS (SELECT track_id, chunk, greatest(0.0, round(x1)) AS x1, greatest(0.0, round(y1)) AS y1, least({WIDTH}.0, round(x2)) AS x2, least({HEIGHT}.0, round(y2)) AS y2 FROM mid),
pm AS (SELECT ed.*, ed.tier = 'low_conf' AND list_contains(hints, 'edge_clip') AND peak >= 0.45 AND greatest(0.0, end_time - start_time) <= 2.5 AND x2 > x1 AND y2 > y1 AND (x2 - x1) * (y2 - y1) / {WIDTH * HEIGHT}.0 BETWEEN 0.0015 AND 0.075 AND (x2 - x1) / greatest(1.0, y2 - y1) BETWEEN 0.45 AND 2.7 AND NOT (y2 >= {HEIGHT * 0.96} AND y1 >= {HEIGHT * 0.72}) AND (ed.track_id * 13 + ed.chunk * 5) % 100 >= 16 AS promoted FROM ed JOIN mc ON mc.track_id = ed.track_id AND mc.chunk = ed.chunk)"""


@query(f"WITH {PROMOTE_SQL} SELECT video_id, track_id, chunk, CASE WHEN promoted THEN 'review' ELSE tier END AS tier, array_to_string(CASE WHEN promoted AND NOT list_contains(hints, 'low_conf_review_candidate') THEN list_append(hints, 'low_conf_review_candidate') ELSE hints END, ',') AS rule_hints FROM pm")
def promoted_events(spark, sf_dir):
    """Low-confidence events at an edge that look like a face go to review, with a hint. The skin share comes from a rule of the id."""
    e = track_events(spark, sf_dir)
    d = track_chunks(spark, sf_dir).select("track_id", "chunk", "t", "frame", "event_id", F.struct(*BOX).alias("box"))
    mid = e.select("track_id", "chunk", ((F.col("start_time") + F.col("end_time")) * 0.5).alias("mid")).join(d, ["track_id", "chunk"])
    mid = mid.groupBy("track_id", "chunk").agg(F.min_by("box", F.struct(F.abs(F.col("t") - F.col("mid")), "frame", "event_id")).alias("b"))
    x = e.join(mid, ["track_id", "chunk"])
    x1, y1, x2, y2 = F.greatest(F.lit(0.0), F.rint("b.x1")), F.greatest(F.lit(0.0), F.rint("b.y1")), F.least(F.lit(float(WIDTH)), F.rint("b.x2")), F.least(F.lit(float(HEIGHT)), F.rint("b.y2"))
    area, aspect = (x2 - x1) * (y2 - y1) / float(WIDTH * HEIGHT), (x2 - x1) / F.greatest(F.lit(1.0), y2 - y1)
    ok = (F.col("tier") == "low_conf") & F.array_contains("hints", "edge_clip") & (F.col("peak") >= 0.45) & (F.greatest(F.lit(0.0), F.col("end_time") - F.col("start_time")) <= 2.5) & (x2 > x1) & (y2 > y1) & area.between(0.0015, 0.075) & aspect.between(0.45, 2.7) & ~((y2 >= HEIGHT * 0.96) & (y1 >= HEIGHT * 0.72)) & ((F.col("track_id") * 13 + F.col("chunk") * 5) % 100 >= 16)
    hints = F.when(ok, F.array_union("hints", F.array(F.lit("low_conf_review_candidate")))).otherwise(F.col("hints"))
    return x.select("video_id", "track_id", "chunk", F.when(ok, "review").otherwise(F.col("tier")).alias("tier"), F.array_join(hints, ",").alias("rule_hints"))


# ---------------------------------------------------------------- candidates at the frame's edge

_STRIDE = 5
_CAND_GAP = max(_STRIDE * 6, int(FPS))
CAND_SQL = f"""{TRACK_SQL}, cand AS (SELECT video_id, frame, event_id, greatest(0.0, x1 - 60) AS x1, y1, x2 - 60 AS x2, y2 FROM tchunk WHERE frame % {_STRIDE} = 0 AND (x1 <= 120 OR y1 <= 80)),
fresh AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM tchunk e WHERE e.video_id = c.video_id AND e.frame = c.frame AND {g.iou_sql("c.", "e.")} >= 0.15)),
cg AS (SELECT *, CAST(sum(CASE WHEN frame - pf > {_CAND_GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY frame, event_id) AS BIGINT) + 1 AS num FROM (SELECT *, lag(frame) OVER (PARTITION BY video_id ORDER BY frame, event_id) AS pf FROM fresh))"""


@query(f"WITH {CAND_SQL} SELECT video_id, printf('bevt_edge_%04d', num) AS event_id, -1000 - num AS track_id, min(frame) AS start_frame, max(frame) AS end_frame, round(min(frame) / {FPS}, 3) AS start_time, round(max(frame) / {FPS}, 3) AS end_time, count(*) AS detection_count FROM cg GROUP BY video_id, num")
def edge_candidates(spark, sf_dir):
    """Boxes at an edge that no detection of their frame overlaps by 0.15, in runs of near frames, as events for review."""
    d = tracked(spark, sf_dir)
    c = d.filter((F.col("frame") % _STRIDE == 0) & ((F.col("x1") <= 120) | (F.col("y1") <= 80))).select("video_id", "frame", "event_id", F.greatest(F.lit(0.0), F.col("x1") - 60).alias("x1"), "y1", (F.col("x2") - 60).alias("x2"), "y2")
    e = d.select(F.col("video_id").alias("_v"), F.col("frame").alias("_f"), *[F.col(k).alias(f"e{k}") for k in BOX])
    fresh = c.join(e, (F.col("video_id") == F.col("_v")) & (F.col("frame") == F.col("_f")) & (g.iou(g.box(), g.box("e")) >= 0.15), "left_anti")
    r = isl.islands(fresh, ["video_id"], ["frame", "event_id"], lambda d: d["frame"] - d["prev_frame"] > _CAND_GAP, ["frame"], "num")
    r = r.withColumn("num", F.col("num") + 1).groupBy("video_id", "num").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count(F.lit(1)).alias("detection_count"))
    return r.select("video_id", F.format_string("bevt_edge_%04d", "num").alias("event_id"), (-1000 - F.col("num")).alias("track_id"), "start_frame", "end_frame", r4(F.col("start_frame") / FPS, 3).alias("start_time"), r4(F.col("end_frame") / FPS, 3).alias("end_time"), "detection_count")


@query(f"""WITH {TRACK_SQL}, first AS (SELECT video_id, min(p) AS p FROM (SELECT video_id, 1 AS p FROM tnum WHERE video_id % 4 = 0 UNION ALL SELECT video_id, 2 FROM tnum WHERE video_id % 4 <> 3 UNION ALL SELECT video_id, 3 FROM tnum) GROUP BY 1)
SELECT t.video_id, CASE p WHEN 1 THEN 'pending' WHEN 2 THEN 'behavior' ELSE 'summary' END AS source, num AS event, n AS frame_count, CASE WHEN p = 3 AND num % 2 = 0 THEN NULL ELSE round(mean, 4) END AS avg_confidence FROM tnum t JOIN first f ON f.video_id = t.video_id""")
def first_available_source(spark, sf_dir):
    """Each video's events from the first source that has any: pending, behaviour, or summary with previews joined where there are some."""
    e = track_events(spark, sf_dir).select("video_id", F.col("num").alias("event"), F.col("n").alias("frame_count"), r4(F.col("mean")).alias("avg_confidence"))
    preview = e.filter("event % 2 = 1").select("video_id", "event", F.col("avg_confidence").alias("_c"))
    summary = e.withColumn("avg_confidence", F.lit(None).cast("double")).join(preview, ["video_id", "event"], "left").select("video_id", "event", "frame_count", F.coalesce("_c", "avg_confidence").alias("avg_confidence"))
    every = [("pending", 1, e.filter("video_id % 4 = 0")), ("behavior", 2, e.filter("video_id % 4 <> 3")), ("summary", 3, summary)]
    rows = None
    for name, p, d in every:
        d = d.withColumn("source", F.lit(name)).withColumn("p", F.lit(p))
        rows = d if rows is None else rows.unionByName(d)
    first = F.min("p").over(Window.partitionBy("video_id"))
    return rows.withColumn("f", first).filter("p = f").select("video_id", "source", "event", "frame_count", "avg_confidence")
