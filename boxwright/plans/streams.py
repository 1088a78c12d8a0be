"""Streaming extensions over the detections as a file source: sessions, tumbling counts, stateful chunks.

Each query runs what is there as a stream, to its end, and reads what the stream has put out. Windows and chunks that
the watermark has not passed stay open, so the last ones are missing, as they would be in a running stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources import sinks
from ..sources.shared import new_path, written
from ..sources.tracked import TRACKED_SQL, tracked
from ..streaming import sessions
from .behavior import TRACK_SQL
from .registry import BOX, query, r4

LATE, GAP = 10_000, 8_000
#: The videos' zero, in milliseconds: a row at the epoch itself would be behind the first watermark, which is 0.
BASE = 1_704_067_200_000


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections as a stream of files, with a time of whole milliseconds."""
    d = tracked(spark, sf_dir).withColumn("ts", F.timestamp_millis(F.floor(F.col("t") * 1000) + BASE))
    path = written(d)
    return spark.readStream.schema(d.schema).parquet(path)


def run(df: DataFrame) -> DataFrame:
    """All that the stream puts out over what is there now."""
    spark, out = df.sparkSession, new_path(df.sparkSession)
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


_MS = "CAST(floor(t * 1000) AS BIGINT)"


@query(f"""WITH {TRACKED_SQL}, m AS (SELECT track_id, conf, event_id, {_MS} AS ms FROM tracked), l AS (SELECT *, ms - lag(ms) OVER (PARTITION BY track_id ORDER BY ms, event_id) AS gap FROM m),
s AS (SELECT *, sum(CASE WHEN gap > 3000 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY ms, event_id) AS seg FROM l), a AS (SELECT track_id, seg, min(ms) AS start_ms, max(ms) + 3000 AS closes_ms, count(*) AS detection_count, round(max(conf), 4) AS peak_confidence FROM s GROUP BY 1, 2)
SELECT track_id, start_ms, closes_ms, detection_count, peak_confidence FROM a WHERE closes_ms <= (SELECT max(ms) FROM m) - {LATE}""")
def stream_presence_sessions(spark, sf_dir):
    """Presence segments of a stream as session windows, as far as they are closed."""
    d = run(sessions.presence_sessions(stream(spark, sf_dir)))
    return d.select("track_id", (F.unix_millis("start_time") - BASE).alias("start_ms"), (F.unix_millis("closes_at") - BASE).alias("closes_ms"), "detection_count", r4(F.col("peak_confidence")).alias("peak_confidence"))


@query(f"WITH {TRACKED_SQL}, m AS (SELECT {_MS} AS ms FROM tracked) SELECT ms // 5000 * 5000 AS start_ms, count(*) AS detections FROM m WHERE ms // 5000 * 5000 + 5000 <= (SELECT max(ms) FROM m) - {LATE} GROUP BY 1")
def stream_stride_counts(spark, sf_dir):
    """Detections in windows of five seconds, as far as they are closed."""
    return run(sessions.stride_counts(stream(spark, sf_dir))).select((F.unix_millis("start_time") - BASE).alias("start_ms"), "detections")


def appended(rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """The log at path once the stream's batches have been appended to it, each key once."""
    spark = rows.sparkSession
    q = rows.writeStream.foreachBatch(lambda batch, i: sinks.append_once(batch, i, path, keys)).option("checkpointLocation", new_path(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(path)


@query(f"WITH {TRACKED_SQL} SELECT video_id, count(*) AS detections, max(frame) AS last_frame, count(DISTINCT track_id) AS tracks FROM tracked GROUP BY 1")
def appended_detections(spark, sf_dir):
    """What a log of the stream's detections holds of each video, appended batch by batch."""
    log = appended(stream(spark, sf_dir), new_path(spark), ["event_id"])
    return log.groupBy("video_id").agg(F.count(F.lit(1)).alias("detections"), F.max("frame").alias("last_frame"), F.count_distinct("track_id").alias("tracks"))


CHUNK = "track_id long, chunk long, n long, start_ms long, end_ms long"


def continuous(a: list[float], b: list[float], ca: float, cb: float) -> bool:
    """The rule of geometry.continuous on plain numbers."""
    w, h = max(0.0, min(a[2], b[2]) - max(a[0], b[0])), max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    need = max(0.05, 0.2 - 0.12 * max(0.0, (ca + cb) / 2 - 0.5))
    dist = (((a[0] + a[2] - b[0] - b[2]) / 2) ** 2 + ((a[1] + a[3] - b[1] - b[3]) / 2) ** 2) ** 0.5
    ref = max(((x[2] - x[0]) ** 2 + (x[3] - x[1]) ** 2) ** 0.5 for x in (a, b))
    return (union > 0 and w * h / union >= need) or (ref > 0 and dist <= 1.5 * ref)


class Chunks(StatefulProcessor):
    """Behaviour chunks of a track, in the order of time whatever the order of arrival.

    Rows wait in a list state until the watermark has passed them; a timer at the earliest one that waits (and one where
    the open chunk ends for want of detections) takes them out in order. What waits is bounded by the lateness allowed.
    The state holds the rows that come together as one value, since each value is a conversion of its own.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.open = handle.getValueState("open", OPEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            if len(pdf):
                self.waiting.appendValue((packed({c: pdf[c].to_numpy() for c in WAITING.names}, len(pdf)),))
                self._wake(int(pdf["ms"].min()))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, done = timerValues.getCurrentWatermarkInMs(), []
        rows = sorted(r for (x,) in self.waiting.get() for r in np.frombuffer(x, WAITING).tolist())
        now, later = [x for x in rows if x[0] <= mark], [x for x in rows if x[0] > mark]
        chunk = self.open.get()  # None before the first
        for ms, frame, event_id, t, conf, *box in now:
            if chunk is None:
                chunk = (0, 1, ms, ms, t, conf, *box)
            elif not chunk[1]:  # the one before has ended by time
                chunk = (chunk[0], 1, ms, ms, t, conf, *box)
            elif t - chunk[4] > GAP / 1000 or not continuous(list(chunk[6:]), box, chunk[5], conf):
                done.append((key[0], *chunk[:4]))
                chunk = (chunk[0] + 1, 1, ms, ms, t, conf, *box)
            else:
                chunk = (chunk[0], chunk[1] + 1, chunk[2], ms, t, conf, *box)
        if chunk is not None and chunk[1] and chunk[3] + GAP < mark:
            done.append((key[0], *chunk[:4]))
            chunk = (chunk[0] + 1, 0, *chunk[2:])
        if chunk is not None:
            self.open.update(chunk)
        if later:
            self.waiting.put([(np.array(later, WAITING).tobytes(),)])
        else:
            self.waiting.clear()
        if later:
            self._wake(later[0][0])
        if chunk is not None and chunk[1]:
            self._wake(chunk[3] + GAP + 1)
        if done:
            yield pd.DataFrame(done, columns=NAMES)

    def _wake(self, at: int) -> None:
        if at not in set(self.handle.listTimers()):
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def packed(columns: dict, n: int) -> bytes:
    """Rows of WAITING's columns as bytes."""
    out = np.empty(n, WAITING)
    for c, v in columns.items():
        out[c] = v
    return out.tobytes()


#: A row that waits, in its order.
WAITING = np.dtype([("ms", "i8"), ("frame", "i8"), ("event_id", "i8"), ("t", "f8"), ("conf", "f8"), *[(c, "f8") for c in BOX]])
OPEN = "chunk long, n long, start_ms long, end_ms long, t double, conf double, x1 double, y1 double, x2 double, y2 double"
NAMES = [f.split()[0] for f in CHUNK.split(", ")]
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def behavior_chunks(rows: DataFrame) -> DataFrame:
    """Closed chunks of a stream (track_id, ts, t, frame, event_id, conf, box). The session's state store becomes RocksDB."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    d = rows.withWatermark("ts", f"{LATE} milliseconds").withColumn("ms", F.unix_millis("ts"))
    return d.select("track_id", "ts", "ms", "frame", "event_id", "t", "conf", *BOX).groupBy("track_id").transformWithStateInPandas(Chunks(), CHUNK, "Append", "EventTime")


@query(f"""WITH {TRACK_SQL}, c AS (SELECT track_id, chunk, count(*) AS n, CAST(floor(arg_min(t, (frame, event_id)) * 1000) AS BIGINT) AS start_ms, CAST(floor(arg_max(t, (frame, event_id)) * 1000) AS BIGINT) AS end_ms FROM tchunk GROUP BY 1, 2),
z AS (SELECT *, lead(start_ms) OVER (PARTITION BY track_id ORDER BY chunk) AS next_ms, (SELECT max({_MS}) FROM tracked) - {LATE} AS mark FROM c)
SELECT track_id, chunk, n, start_ms, end_ms FROM z WHERE next_ms <= mark OR end_ms + {GAP} < mark""")
def stream_behavior_chunks(spark, sf_dir):
    """Behaviour chunks of a stream with state by track: closed by the next detection, or for want of one, once the watermark has passed that."""
    out = run(behavior_chunks(stream(spark, sf_dir)))
    return out.select("track_id", "chunk", "n", (F.col("start_ms") - BASE).alias("start_ms"), (F.col("end_ms") - BASE).alias("end_ms"))
