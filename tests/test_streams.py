"""Streams over many batches: files read one by one, rows late and out of order within the watermark, and beyond it."""

import random

import pytest
from pyspark.sql import functions as F

from boxwright.plans import streams

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    d = streams.tracked(spark, SF).withColumn("ts", F.timestamp_millis(F.floor(F.col("t") * 1000) + streams.BASE))
    return sorted(d.collect(), key=lambda r: (r.ts, r.event_id)), d.schema


def fed(spark, tmp_path, files, schema):
    """The stream of files, one a batch."""
    for i, part in enumerate(files):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{i:03d}")
    import glob
    import os
    import shutil

    os.makedirs(f"{tmp_path}/in")
    for i in range(len(files)):
        (src,) = glob.glob(f"{tmp_path}/{i:03d}/*.parquet")
        shutil.copy(src, f"{tmp_path}/in/{i:03d}.parquet")
        os.utime(f"{tmp_path}/in/{i:03d}.parquet", (1_700_000_000 + i * 60,) * 2)  # files are taken by age
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def loop(rows, mark):
    """Chunks of each track in order of time, as far as they are closed when the watermark is mark."""
    by, out = {}, set()
    for r in sorted(rows, key=lambda r: (r.ts, r.frame, r.event_id)):
        by.setdefault(r.track_id, []).append(r)
    ms = lambda r: int(r.ts.timestamp() * 1000 + 0.5) - streams.BASE
    for track, dets in by.items():
        chunks = [[dets[0]]]
        for a, b in zip(dets, dets[1:], strict=False):
            box = lambda r: [r.x1, r.y1, r.x2, r.y2]
            if b.t - a.t > streams.GAP / 1000 or not streams.continuous(box(a), box(b), a.conf, b.conf):
                chunks.append([])
            chunks[-1].append(b)
        for k, c in enumerate(chunks):
            follows = ms(chunks[k + 1][0]) if k + 1 < len(chunks) else None
            if (follows is not None and follows <= mark) or ms(c[-1]) + streams.GAP < mark:
                out.add((track, k, len(c), ms(c[0]), ms(c[-1])))
    return out


def got(out):
    rows = [(r.track_id, r.chunk, r.n, r.start_ms - streams.BASE, r.end_ms - streams.BASE) for r in streams.run(out).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_chunks_over_many_late_batches(spark, rows, tmp_path):
    """Rows come up to 9 s of stream time late, in six files: the result is that of all rows in order."""
    all_rows, schema = rows
    rng = random.Random(2)
    late = sorted(all_rows, key=lambda r: r.ts.timestamp() + rng.random() * 9)
    size = -(-len(late) // 6)
    files = [late[i : i + size] for i in range(0, len(late), size)]
    mark = max(int(r.ts.timestamp() * 1000 + 0.5) for r in all_rows) - streams.BASE - streams.LATE
    assert got(streams.behavior_chunks(fed(spark, tmp_path, files, schema))) == loop(all_rows, mark)


def test_rows_behind_the_watermark_are_dropped(spark, rows, tmp_path):
    all_rows, schema = rows
    n = len(all_rows)
    old = all_rows[: n // 20]
    rest = all_rows[n // 20 :]
    files = [rest[: len(rest) // 2], rest[len(rest) // 2 : -5], [*old, *rest[-5:]]]
    mark = max(int(r.ts.timestamp() * 1000 + 0.5) for r in rest) - streams.BASE - streams.LATE
    first = max(r.ts for r in files[0]).timestamp() - streams.LATE / 1000
    assert all(r.ts.timestamp() < first for r in old)
    assert got(streams.behavior_chunks(fed(spark, tmp_path, files, schema))) == loop(rest, mark)


def test_sessions_and_windows_over_many_batches(spark, rows, tmp_path):
    from boxwright.streaming import sessions

    all_rows, schema = rows
    size = -(-len(all_rows) // 5)
    files = [all_rows[i : i + size] for i in range(0, len(all_rows), size)]
    mark = max(r.ts for r in all_rows).timestamp() - streams.LATE / 1000
    out = streams.run(sessions.stride_counts(fed(spark, tmp_path, files, schema))).collect()
    want = {}
    for r in all_rows:
        want[int(r.ts.timestamp() // 5 * 5)] = want.get(int(r.ts.timestamp() // 5 * 5), 0) + 1
    assert {int(r.start_time.timestamp()): r.detections for r in out} == {k: v for k, v in want.items() if k + 5 <= mark}


def test_a_batch_that_comes_again_changes_nothing(spark, rows, tmp_path):
    from boxwright.sources import sinks
    from boxwright.sources.shared import new_path

    all_rows, schema = rows
    third = len(all_rows) // 3
    files = [all_rows[:third], all_rows[third - 20 : 2 * third], [*all_rows[2 * third :], *all_rows[-3:]]]  # some rows come twice
    path = new_path(spark)
    streams.appended(fed(spark, tmp_path, files, schema), path, ["event_id"])
    state = lambda: sorted((r.batch_id, r.event_id) for r in spark.read.parquet(path).select("batch_id", "event_id").collect())
    before = state()
    assert sorted(i for _, i in before) == sorted(r.event_id for r in all_rows) and len({b for b, _ in before}) == 3
    for i, part in enumerate(files):
        sinks.append_once(spark.createDataFrame(part, schema), i, path, ["event_id"])
        assert state() == before
    sinks.append_once(spark.createDataFrame(files[0], schema), 9, path, ["event_id"])
    assert state() == before


def test_rows_that_come_together_wait_as_one_value(spark, monkeypatch):
    """A value of the state is a conversion and a message of its own, so it holds all rows of a batch; no empty frames come out."""
    import pandas as pd

    kept, timers = {}, set()

    class State:
        def __init__(self, name):
            self.name, self.calls = name, 0

        def exists(self):
            return self.name in kept

        def get(self):
            return iter(kept.get(self.name, [])) if self.name == "waiting" else kept.get(self.name)

        def appendValue(self, v):
            kept.setdefault(self.name, []).append(v)

        def appendList(self, v):
            kept.setdefault(self.name, []).extend(v)

        put = update = lambda self, v: kept.__setitem__(self.name, v)
        clear = lambda self: kept.pop(self.name, None)

    class Handle:
        getListState = getValueState = lambda self, name, schema: State(name)
        listTimers = lambda self: iter(timers)
        registerTimer = lambda self, at: timers.add(at)

    class Now:
        getCurrentWatermarkInMs = lambda self: 2_500

    p = streams.Chunks()
    p.init(Handle())
    d = pd.DataFrame([(1000 * i, 30 * i, 2**60 + i, float(i), 0.5, 0.0, 0.0, 10.0, 10.0) for i in (3, 1, 2, 0)], columns=["ms", "frame", "event_id", "t", "conf", *streams.BOX])
    assert list(p.handleInputRows((7,), iter([d, d.iloc[:0]]), Now())) == [] and len(kept["waiting"]) == 1 and timers == {0}
    assert list(p.handleExpiredTimer((7,), Now(), None)) == []
    assert tuple(kept["open"])[:4] == (0, 3, 0, 2000)  # those the watermark has passed, in order
    (left,) = kept["waiting"]
    import numpy as np

    assert np.frombuffer(left[0], streams.WAITING).tolist() == [(3000, 90, 2**60 + 3, 3.0, 0.5, 0.0, 0.0, 10.0, 10.0)]
