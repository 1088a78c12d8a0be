"""Table functions for SQL users: SELECT * FROM stand_frames(TABLE(detections), fill => 15, hold => 10).

Plans use the expressions of plans/timeline.py, which stay in the JVM; this is the same rule for those who write SQL.
stand_frames takes a table as it is, row by row; StandBatches takes one whose rows say what follows them, and computes on
Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

#: Columns that are drawn in lines between detections, those that order them, and the last frame of their video.
VALUES, ORDER, LAST = ("x1", "y1", "x2", "y2", "conf"), ("frame", "event_id"), "vl"


class StandFrames:
    """Detections of a table with the frames that they stand for: the gap to the next if it has `fill` frames at most, and `hold` frames at both ends.

    The table has frame, event_id, vl, a box and a confidence; each value of all its other columns is a group of its
    own, whose rows come in order. The result has those columns, f, and the values. A group holds one row at a time.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, fill: AnalyzeArgument, hold: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("stand_frames takes a table first")
        have = {f.name: f for f in rows.dataType.fields}
        lacking = [c for c in (*VALUES, *ORDER, LAST) if c not in have]
        if lacking:
            raise ValueError(f"stand_frames needs the columns {', '.join(lacking)}")
        if fill.value is None or hold.value is None or fill.value < 0 or hold.value < 0:
            raise ValueError("fill and hold are whole numbers, 0 at least")
        keys = [f for f in rows.dataType.fields if f.name not in (*VALUES, *ORDER, LAST)]
        if not keys:
            raise ValueError("stand_frames needs a column that tells groups apart")
        schema = StructType([*keys, StructField("f", LongType()), *[have[c] for c in VALUES]])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(f.name) for f in keys], orderBy=[OrderingColumn(c) for c in ORDER])

    def __init__(self):
        self.before, self.hold = None, 0

    def eval(self, row, fill, hold):
        self.hold, old = hold, self.before
        key = tuple(row[c] for c in row.__fields__ if c not in (*VALUES, *ORDER, LAST))
        frame, values = row["frame"], tuple(row[c] for c in VALUES)
        if old is None:
            for f in range(max(0, frame - hold), frame):
                yield (*key, f, *values)
        elif 1 < frame - old[1] <= fill:
            for f in range(old[1] + 1, frame):
                share = (f - old[1]) / (frame - old[1])
                yield (*key, f, *[a + (z - a) * share for a, z in zip(old[2], values)])
        yield (*key, frame, *values)
        self.before = (key, frame, values, row[LAST])

    def terminate(self):
        if self.before is not None:
            key, frame, values, last = self.before
            for f in range(frame + 1, min(last, frame + self.hold) + 1):
                yield (*key, f, *values)


#: What a row of StandBatches' table says of its group: the next frame (null at the last row), and whether it is the first.
NEXT, FIRST = "nf", "first"


class StandBatches:
    """As StandFrames over a table that has nf, first and n<value> too; each row gives its frames by itself, so rows come as they lie.

    All its other columns are given back beside f and the values. A batch gives at most 2 * hold + fill frames a row.
    """

    def eval(self, rows, fill, hold):
        import numpy as np
        import pyarrow as pa

        fill, hold = fill[0].as_py(), hold[0].as_py()
        number = lambda c: rows.column(c).to_numpy(zero_copy_only=False)
        frame, last = number("frame"), rows.column(NEXT).is_null().to_numpy(zero_copy_only=False)
        then = rows.column(NEXT).fill_null(0).to_numpy(zero_copy_only=False)
        lo = np.where(number(FIRST), np.maximum(0, frame - hold), frame)
        hi = np.where(last, np.maximum(frame, np.minimum(number(LAST), frame + hold)), frame)
        line = ~last & (then - frame > 1) & (then - frame <= fill)
        n = np.where(line, then - 1, hi) - lo + 1
        at = np.repeat(np.arange(len(n)), n)
        f = lo[at] + np.arange(len(at)) - (np.cumsum(n) - n)[at]
        drawn = f > hi[at]
        share = (f - frame[at]) / np.where(line, then - frame, 1)[at]
        columns = {c: rows.column(c).take(pa.array(at)) for c in rows.schema.names if c not in (*VALUES, *ORDER, LAST, NEXT, FIRST, *[f"n{v}" for v in VALUES])}
        columns["f"] = pa.array(f)
        for c in VALUES:
            a = number(c)[at]
            z = rows.column(f"n{c}").fill_null(0.0).to_numpy(zero_copy_only=False)[at]
            columns[c] = pa.array(np.where(drawn, a + (z - a) * share, a))
        yield pa.table(columns)


def register_batches(spark: SparkSession, name: str, keys: str) -> None:
    """StandBatches for tables of some key columns (names and types, in their order) as a table function of the session's SQL."""
    from pyspark.sql.functions import arrow_udtf

    spark.udtf.register(name, arrow_udtf(StandBatches, returnType=f"{keys}, f long, " + ", ".join(f"{c} double" for c in VALUES)))


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session's SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("stand_frames", udtf(StandFrames))
