"""Readers, run lengths, pages and observed stages against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from boxwright.operators import paging, runs
from boxwright.sources import observed, readers

GOOD = '{"events": [{"event_id": "a", "track_id": 1, "tier": "auto", "start_frame": 3, "end_frame": 9}, {"event_id": "b", "track_id": 2}]}'


def stored(folder, documents):
    for video, texts in documents.items():
        place = folder / f"video_id={video}"
        place.mkdir(parents=True)
        for i, text in enumerate(texts):
            (place / f"{i}.json").write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(folder)


def test_broken_documents_are_kept_apart(spark, tmp_path):
    documents = {
        1: [GOOD], 2: [GOOD.replace(", ", ",\n\n")], 3: [b"\xef\xbb\xbf" + GOOD.encode()], 4: [GOOD[:50]], 5: ['{"events": 7}'], 6: [""], 7: [" \n"], 8: ["{}"], 9: ['{"events": null, "events_more": [1]}'],
        10: ["[]"], 11: ["not json", GOOD], 12: ['{"events": [{"event_id": "a", "track_id": 1}, {"event_id": "a", "track_id": 5}]}'], 13: ['{"events": [{"event_id": "a", "track_id": "x"}]}'],
    }
    good, bad = readers.read_documents(spark, stored(tmp_path / "d", documents), "final_events")
    assert sorted(r.video_id for r in good.collect()) == [1, 2, 3, 8, 9, 11, 12]
    texts = sorted((r.video_id, r.text) for r in bad.collect())
    assert [v for v, _ in texts] == [4, 5, 7, 10, 11, 13]
    assert dict(texts)[4] == GOOD[:50] and dict(texts)[7] == "" and dict(texts)[11] == "not json"
    rows = sorted((r.video_id, r.event_id, r.track_id, r.end_frame) for r in readers.keyed(good, "final_events", ["video_id"]).collect())
    assert [r for r in rows if r[0] != 12] == [(v, i, t, e) for v in (1, 2, 3, 11) for i, t, e in (("a", 1, 9), ("b", 2, None))]
    assert [r for r in rows if r[0] == 12] == [(12, "a", 5, None)]  # the last of an id
    expected = spark.createDataFrame([(v,) for v in (1, 4, 6, 11, 99)], "video_id long")
    assert sorted(map(tuple, readers.status_by_key(expected, good, bad, ["video_id"]).collect())) == [(1, "read"), (4, "broken"), (6, "missing"), (11, "read"), (99, "missing")]


def test_what_is_not_there(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_documents(spark, str(tmp_path / "none"), "identity_clusters")
    good, bad = readers.read_documents(spark, str(tmp_path / "none"), "mask_timeline")
    assert good.columns == ["video_id", "proposals"] and good.count() == 0 and bad.columns == ["video_id", "path", "text"] and bad.count() == 0
    assert readers.keyed(good, "mask_timeline", ["video_id"]).count() == 0


@pytest.mark.parametrize("block, span", [(4096, 65536), (3, 7), (1, 1)])
def test_decode_times_equal_a_walk_over_all_samples(spark, block, span):
    rnd = random.Random(5)
    tables = {k: [(rnd.choice([0, 1, 1, 2, 9, 40]), rnd.randint(1, 50)) for _ in range(60)] for k in range(3)}
    tables[3] = [(5000, 7)]
    samples = {k: {rnd.randint(-1, sum(n for n, _ in t) + 5) for _ in range(200)} for k, t in tables.items()}
    want = set()
    for k, t in tables.items():
        number, now = 1, 0
        for n, delta in t:
            for _ in range(n):
                if number in samples[k]:
                    want.add((k, number, now))
                number, now = number + 1, now + delta
    table = spark.createDataFrame([(k, 3 * i - 50, n, d) for k, t in tables.items() for i, (n, d) in enumerate(t)], "k long, i long, n long, d long")
    wanted = spark.createDataFrame([(k, s) for k, v in samples.items() for s in v], "k long, s long")
    got = runs.at_elements(wanted, runs.prefixed(table, ["k"], "i", "n", "d", block), ["k"], "s", "n", "d", span)
    assert sorted((r.k, r.s, r.total) for r in got.collect()) == sorted(want)


def test_pages_follow_one_order(spark):
    rnd = random.Random(2)
    rows = [(None if i % 50 == 0 else rnd.randint(0, 5) if i % 3 else 1, i) for i in range(1000)]
    rnd.shuffle(rows)
    d = paging.numbered(spark.createDataFrame(rows, "a long, b long").repartition(7), ["a", "b"], 6)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = lambda x: [(r.a, r.b) for r in sorted(x.collect(), key=lambda r: r.number)]
    assert got(d) == order and sorted(r.number for r in d.collect()) == list(range(1000))
    assert got(paging.page(d, 990, 50)) == order[990:] and got(paging.page(d, -4, 10)) == order[:10] and got(paging.page(d, 400, 0)) == order[400:]
    assert got(paging.page(d, 2000, 5)) == [] and got(paging.numbered(d.filter("a = 77").select("a", "b"), ["a", "b"])) == []


def test_counts_come_while_stages_run(spark):
    run = observed.Stages(spark, observed.tier_counts())
    d = spark.range(100).withColumn("tier", F.when(F.col("id") < 30, "auto").when(F.col("id") < 40, "low_conf"))
    assert run.run("events", d).count() == 100
    run.run("plain", spark.range(7))
    run.run("empty", d.filter("id < 0"))
    rows = [tuple(r) for r in run.report().orderBy("step").drop("seconds").collect()]
    assert rows == [(0, "events", 100, 30, 0, 10), (1, "plain", 7, None, None, None), (2, "empty", 0, 0, 0, 0)]
    assert set(run.seconds) == {"events", "plain", "empty"} and all(s > 0 for s in run.seconds.values())


def test_documents_are_written_by_as_many_tasks_as_they_need(spark, tmp_path, monkeypatch):
    """Adaptive execution would join so few bytes to one task, which would write the file of each video in turn."""
    from boxwright.plans import stored as plan

    us = 1_704_067_200_000_000 + F.floor(F.col("id") / 120).cast("long") * 7_200_000_000
    e = spark.range(1200).select(F.col("id").alias("event_id"), F.timestamp_micros(us).alias("ts"), (F.col("id") % 120).alias("user_id"), F.lit("view").alias("event_type"), F.lit(0.95).alias("value"), F.lit('{"k": 7}').alias("props"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(plan, "TASK_DOCUMENTS", 2, raising=False)
    from pathlib import Path

    files = list(Path(plan.store(spark, str(tmp_path))).glob("final_events/video_id=*/*.txt"))
    assert len(files) == 12 and len({f.name.split("-")[1] for f in files}) > 2
    default = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    found = plan.stored_documents(spark, str(tmp_path)).groupBy("status").count().collect()
    assert sum(r["count"] for r in found) == 48 and spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == default
