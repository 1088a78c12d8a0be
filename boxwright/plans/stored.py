"""Stored documents read with what is broken kept apart, counts taken while stages run, pages in a global order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import paging
from ..sources import readers
from ..sources.observed import Stages, tier_counts
from ..sources.shared import cut, new_path
from ..sources.tracked import FPS, tracked
from .behavior import TRACK_SQL, track_events
from .registry import query, r4
from .timeline import PROPOSAL_SQL, proposals

#: How a video's document of each kind is stored, by video_id % 5 plus the kind's number: 3 is cut off, 4 has a list in
#: place of its text, optional kinds have none at 1; 0 has a byte order mark, 2 is written over many lines.
_ORDER = tuple(readers.KINDS)
#: Documents that a task writes, each a file in a folder of its own.
TASK_DOCUMENTS = 50


def store(spark: SparkSession, sf_dir: str) -> str:
    """Four documents for each video in folders of their own, some of them broken or left out: the folder."""
    e = track_events(spark, sf_dir)
    e = cut(e.select("video_id", "num", "track_id", "tier", "start_frame", "end_frame"))
    root = new_path(spark)
    # their number is asked for: adaptive execution joins partitions by bytes, and one task would write most of the files
    tasks = max(1, -(-e.select("video_id").distinct().count() // TASK_DOCUMENTS))
    of = {
        "identity_clusters": F.struct(F.format_string("id_%04d", "num").alias("identity_id"), F.array("track_id").alias("track_ids"), r4(F.col("start_frame") / FPS, 3).alias("start_time"), r4(F.col("end_frame") / FPS, 3).alias("end_time")),
        "final_events": F.struct(F.format_string("evt_%04d", "num").alias("event_id"), "track_id", "tier", "start_frame", "end_frame"),
        "mask_timeline": F.struct(F.format_string("mask_%04d", "num").alias("proposal_id"), "track_id", "start_frame", "end_frame"),
        "event_segment_map": F.struct(F.format_string("evt_%04d", "num").alias("event_id"), "track_id", "start_frame", "end_frame"),
    }
    for i, (kind, row) in enumerate(of.items()):
        name = readers.KINDS[kind].split()[0]
        docs = e.groupBy("video_id").agg(F.array_sort(F.collect_list(row)).alias(name))
        text, how = F.to_json(F.struct(name)), (F.col("video_id") + i) % 5
        if kind not in readers.REQUIRED:
            docs = docs.filter(how != 1)
        value = F.when(how == 3, F.substring(text, 1, 40)).when(how == 4, F.regexp_replace(text, '"track_ids?":', '"track_id":"x","track_ids":"y","was":')).when(how == 0, F.concat(F.lit("﻿"), text)).when(how == 2, F.regexp_replace(text, r"\},\{", "},\n  {")).otherwise(text)
        out = docs.select("video_id", value.alias("value")).repartition(tasks, "video_id").write.partitionBy("video_id")
        out.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(f"{root}/{kind}")  # tasks move their files, not the driver
    return root


def _stored_sql() -> str:
    kinds = []
    for i, kind in enumerate(_ORDER):
        gone = "" if kind in readers.REQUIRED else "WHEN how = 1 THEN 'missing' "
        kinds.append(f"SELECT video_id, '{kind}' AS kind, CASE {gone}WHEN how IN (3, 4) THEN 'broken' ELSE 'read' END AS status, n, tracks, last_end FROM (SELECT video_id, (video_id + {i}) % 5 AS how, count(*) AS n, CAST(sum(track_id) AS BIGINT) AS tracks, max({'round(end_frame / ' + str(FPS) + ', 3)' if i == 0 else 'CAST(end_frame AS DOUBLE)'}) AS last_end FROM tnum GROUP BY 1)")
    return f"WITH {TRACK_SQL} SELECT video_id, kind, status, CASE WHEN status = 'read' THEN n ELSE 0 END AS rows_read, CASE WHEN status = 'read' THEN tracks END AS tracks, CASE WHEN status = 'read' THEN last_end END AS last_end FROM ({' UNION ALL '.join(kinds)})"


@query(_stored_sql())
def stored_documents(spark, sf_dir):
    """Cluster, final, timeline and segment-map documents of all videos, read back: what each holds, and which are broken or missing."""
    root = store(spark, sf_dir)
    expected = tracked(spark, sf_dir).select("video_id").distinct()
    out = []
    for kind in _ORDER:
        docs, broken = readers.read_documents(spark, f"{root}/{kind}", kind)
        rows = readers.keyed(docs, kind, ["video_id"])
        clusters = kind == "identity_clusters"
        track = F.aggregate("track_ids", F.lit(0).cast("long"), lambda s, v: s + v) if clusters else F.col("track_id")
        found = rows.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.sum(track).alias("tracks"), F.max(F.col("end_time" if clusters else "end_frame").cast("double")).alias("last_end"))
        d = readers.status_by_key(expected, docs, broken, ["video_id"]).join(found, "video_id", "left")
        out.append(d.select("video_id", F.lit(kind).alias("kind"), "status", F.coalesce("n", F.lit(0).cast("long")).alias("rows_read"), "tracks", "last_end"))
    return reduce(DataFrame.unionByName, out)


def observed_stages(spark: SparkSession, sf_dir: str) -> Stages:
    """A run's stages (detections, events, proposals), each written with its counts."""
    run = Stages(spark, tier_counts())
    run.run("detections", tracked(spark, sf_dir))
    run.run("events", track_events(spark, sf_dir))
    run.run("proposals", proposals(spark, sf_dir))
    return run


@query(f"""WITH {PROPOSAL_SQL}, c AS (SELECT 1 AS step, 'events' AS stage, tier FROM tnum UNION ALL SELECT 2, 'proposals', tier FROM prop)
SELECT CAST(step AS INTEGER) AS step, stage, count(*) AS rows, count(*) FILTER (tier = 'auto') AS auto, count(*) FILTER (tier = 'review') AS review, count(*) FILTER (tier = 'low_conf') AS low_conf FROM c GROUP BY 1, 2
UNION ALL SELECT 0, 'detections', count(*), NULL, NULL, NULL FROM tracked""")
def observed_run(spark, sf_dir):
    """Rows that pass each stage of a run, and how many of each tier, observed while the stages are written."""
    return observed_stages(spark, sf_dir).report().drop("seconds")


PAGE = 50


@query(f"WITH {PROPOSAL_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY start_frame, video_id, proposal_id) - 1 AS number FROM prop WHERE tier <> 'auto') SELECT number, number // {PAGE} AS page, video_id, proposal_id, start_frame, end_frame FROM o")
def review_pages(spark, sf_dir):
    """Proposals to be reviewed in the order of the queue, numbered through all videos, and their pages."""
    p = proposals(spark, sf_dir).filter("tier <> 'auto'").select("start_frame", "video_id", "proposal_id", "end_frame")
    d = paging.numbered(p, ["start_frame", "video_id", "proposal_id"])
    return d.select("number", F.floor(F.col("number") / PAGE).alias("page"), "video_id", "proposal_id", "start_frame", "end_frame")
