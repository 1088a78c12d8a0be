"""Events with their trajectories: presence events, and merged ones whose parts' trajectories are put together in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records
from ..operators import islands as isl
from ..sources.tracked import tracked
from .behavior import MERGE_GAP, PRESENCE_GAP, SEG_EVENT_SQL, _edge_sql, merge_edges, presence_events
from .registry import BOX, ORDER, query


def presence_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track_id, seg, trajectory) of presence segments."""
    d = isl.islands(tracked(spark, sf_dir), ["track_id"], ORDER, lambda d: d["t"] - d["prev_t"] > PRESENCE_GAP, ["t"])
    return records.with_trajectories(d, ["track_id", "seg"])


def merged_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, track_id, grp, trajectory) of merged events: their presence events' in order of start."""
    parts = merge_edges(spark, sf_dir, "event_gap", MERGE_GAP).select("video_id", "track_id", "seg", "grp", "start_time", "start_frame")
    return records.concatenated(parts.join(presence_trajectories(spark, sf_dir), ["track_id", "seg"], "left"), ["video_id", "track_id", "grp"], ["start_time", "start_frame", "seg"])


def _shown() -> list:
    """A trajectory's points as text, and its folds."""
    tr = F.col("trajectory")
    first, last, peak = records.first_point(tr), records.last_point(tr), records.peak_point(tr)
    text = F.array_join(F.transform(tr, lambda p: F.format_string("%d:%.4f", p["frame"], p["conf"])), ",")
    return [
        F.size(tr).cast("long").alias("points"), text.alias("path"), first["frame"].alias("first_frame"), last["frame"].alias("last_frame"), peak["frame"].alias("peak_frame"), peak["conf"].alias("peak_confidence"),
        *[first["bbox"][i].alias(f"first_{c}") for i, c in enumerate(BOX)], *[last["bbox"][i].alias(f"last_{c}") for i, c in enumerate(BOX)], F.coalesce(records.largest_gap(tr), F.lit(0.0)).alias("largest_gap_sec"),
    ]


def _shown_sql(order: str) -> str:
    low = ", ".join(f"-{c.strip()}" for c in order.split(","))
    return f"""CAST(count(*) AS BIGINT) AS points, string_agg(printf('%d:%.4f', frame, round(conf, 4)), ',' ORDER BY {order}) AS path, arg_min(frame, ({order})) AS first_frame, arg_max(frame, ({order})) AS last_frame, arg_max(frame, (round(conf, 4), {low})) AS peak_frame, round(max(conf), 4) AS peak_confidence,
    {", ".join(f"arg_min(round({c}, 1), ({order})) AS first_{c}" for c in BOX)}, {", ".join(f"arg_max(round({c}, 1), ({order})) AS last_{c}" for c in BOX)}, coalesce(max(gap_ms), 0.0) AS largest_gap_sec"""


@query(f"""WITH {SEG_EVENT_SQL}, pt AS (SELECT *, round(round(t, 3) - lag(round(t, 3)) OVER (PARTITION BY track_id, seg ORDER BY frame, event_id), 3) AS gap_ms FROM seg3), tr AS (SELECT track_id, seg, {_shown_sql("frame, event_id")} FROM pt GROUP BY 1, 2)
SELECT video_id, printf('evt_%04d', num) AS event_id, tier, tr.* FROM se JOIN tr USING (track_id, seg)""")
def face_event_trajectories(spark, sf_dir):
    """Presence events as records that hold their trajectory, with its first, last and highest point."""
    e = presence_events(spark, sf_dir).select("video_id", "track_id", "seg", "num", "tier")
    d = e.join(presence_trajectories(spark, sf_dir), ["track_id", "seg"])
    return d.select("video_id", F.format_string("evt_%04d", "num").alias("event_id"), "tier", "track_id", "seg", *_shown())


_PART = "start_time, start_frame, seg, frame, event_id"


@query(f"""WITH {_edge_sql("event_gap", MERGE_GAP)}, pt0 AS (SELECT s.*, grp, start_time, start_frame FROM seg3 s JOIN (SELECT track_id, seg, grp, start_time, start_frame FROM mg) USING (track_id, seg)),
pt AS (SELECT *, round(round(t, 3) - lag(round(t, 3)) OVER (PARTITION BY track_id, grp ORDER BY {_PART}), 3) AS gap_ms FROM pt0)
SELECT any_value(video_id) AS video_id, track_id, grp, {_shown_sql(_PART)} FROM pt GROUP BY track_id, grp""")
def merged_event_trajectories(spark, sf_dir):
    """Merged presence events with one trajectory, put together of their parts' in order."""
    return merged_trajectories(spark, sf_dir).select("video_id", "track_id", "grp", *_shown())


def hint_union(parts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys with the parts' hints in the order in which they first come, each once, and how many parts were merged if several."""
    m = parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(*order, F.coalesce("hints", F.array().cast("array<string>")).alias("hints")))).alias("m"))
    each = F.array_distinct(F.flatten(F.transform("m", lambda x: x["hints"])))
    return m.select(*keys, F.when(F.col("n") > 1, F.array_append(each, F.format_string("behavior_merge:%d", "n"))).otherwise(each).alias("rule_hints"))


@query(f"""WITH {_edge_sql("event_gap", MERGE_GAP)}, g AS (SELECT video_id, track_id, grp, count(*) AS n FROM mg GROUP BY 1, 2, 3), pos AS (SELECT track_id, grp, hints, row_number() OVER (PARTITION BY track_id, grp ORDER BY start_time, start_frame, seg) AS part FROM mg),
one AS (SELECT track_id, grp, hint, min(part * 100 + i) AS first_at FROM (SELECT track_id, grp, part, unnest(hints) AS hint, unnest(range(len(hints))) AS i FROM pos) GROUP BY 1, 2, 3), h AS (SELECT track_id, grp, string_agg(hint, ',' ORDER BY first_at) AS hints FROM one GROUP BY 1, 2)
SELECT g.video_id, g.track_id, g.grp, concat_ws(',', hints, CASE WHEN n > 1 THEN 'behavior_merge:' || n END) AS rule_hints FROM g LEFT JOIN h ON g.track_id = h.track_id AND g.grp = h.grp""")
def merged_event_hints(spark, sf_dir):
    """Hints of merged events in the order of their parts."""
    d = hint_union(merge_edges(spark, sf_dir, "event_gap", MERGE_GAP), ["video_id", "track_id", "grp"], ["start_time", "start_frame", "seg"])
    return d.select("video_id", "track_id", "grp", F.array_join("rule_hints", ",").alias("rule_hints"))
