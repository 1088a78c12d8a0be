"""The table function beside the plan's expressions, on random groups."""

import random

import pytest
from pyspark.sql import functions as F

from boxwright.functions import tables
from boxwright.plans import timeline


def test_the_table_function_equals_the_expressions(spark):
    tables.register(spark)
    rnd = random.Random(8)
    rows = []
    for k in range(12):
        frames = [rnd.choice([0, 0, 3, 50]) for _ in range(1 + k % 3)] if k < 3 else sorted(rnd.sample(range(120), 20))
        rows += [(k % 4, f"g{k}", f, rnd.randrange(10**6), 119, *[float(rnd.randrange(500)) for _ in range(4)], rnd.random()) for f in frames]
    d = spark.createDataFrame(rows, "video_id long, g string, frame long, event_id long, vl long, x1 double, y1 double, x2 double, y2 double, conf double").repartition(3)
    got = spark.sql("SELECT * FROM stand_frames(TABLE({rows}), fill => 6, hold => 4)", rows=d)
    assert got.columns == ["video_id", "g", "f", "x1", "y1", "x2", "y2", "conf"]
    want = timeline.written_out(timeline.spread(d, ["video_id", "g"], 6, 4), ["video_id", "g"])
    key = lambda x: sorted(tuple(r) for r in x.select(*got.columns).collect())
    assert key(got) == key(want) and got.count() > len(rows)
    assert spark.sql("SELECT * FROM stand_frames(TABLE({rows}), fill => 6, hold => 4)", rows=d.filter("frame < 0")).count() == 0


def test_what_the_table_function_refuses(spark):
    tables.register(spark)
    d = spark.range(3).select("id", F.col("id").alias("frame"))
    with pytest.raises(Exception, match="needs the columns"):
        spark.sql("SELECT * FROM stand_frames(TABLE({rows}), fill => 6, hold => 4)", rows=d).collect()


def test_the_function_on_batches_equals_the_expressions(spark, tmp_path):
    """The query's frames are those of the expressions; Python gets Arrow batches, and no shuffle is made for it."""
    us = 1_704_067_200_000_000 + (F.floor(F.col("id") / 40) * 1_700_000_000 * (1 + F.floor(F.col("id") / 400))).cast("long")
    e = spark.range(2000).select(F.col("id").alias("event_id"), F.timestamp_micros(us).alias("ts"), (F.col("id") % 40).alias("user_id"), F.lit("view").alias("event_type"), (F.col("id") % 97 / 100).alias("value"), F.lit('{"k": 7}').alias("props"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    d = timeline.proposal_rows(spark, str(tmp_path)).select("video_id", *timeline.KEYS, "frame", "event_id", "vl", *timeline.VALUES)
    got = timeline.proposal_entries_by_table_function(spark, str(tmp_path))
    want = timeline.written_out(timeline.spread(d, ["video_id", *timeline.KEYS], timeline.FILL, timeline.HOLD), ["video_id", *timeline.KEYS]).withColumnRenamed("f", "frame")
    key = lambda x: sorted(tuple(r) for r in x.select(*got.columns).collect())
    assert key(got) == key(want) and got.count() > 2 * d.count() > 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPythonUDTF" in plan and plan.count("Exchange") == d._jdf.queryExecution().executedPlan().toString().count("Exchange")
