"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of this machine in local mode, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_folder(spark).rstrip('/')}/boxwright-{uuid.uuid4().hex}"


def written(df: DataFrame) -> str:
    """Where df is now written, as a table in the shared folder."""
    path = new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    Later jobs and lost executors don't recompute it. A written table rather than checkpoint(): a plan over it
    starts afresh, where a checkpoint carries the constraints of its origin along, which grow from round to round.
    """
    return df.sparkSession.read.schema(df.schema).parquet(written(df))


#: Detections of a partition whose rows are to be written out by frame.
SHARE = 50_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by keys, in a partition for each SHARE of rows, the rows of its source.

    Adaptive execution joins partitions by the bytes that they read, and what writes rows out afterwards then grows
    with the input in each task. It leaves a number that is asked for as it is.
    """
    return df.repartition(max(1, -(-rows // SHARE)), *keys)
