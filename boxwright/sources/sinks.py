"""Sinks: documents as single JSON rows, review packs, decision upserts, audit lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def document(rows: DataFrame, header: dict, name: str, keys: list[str]) -> DataFrame:
    """One JSON document for each key (a video): header fields and the key's rows as an ordered array."""
    body = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[c for c in rows.columns if c not in keys]))).alias(name))
    return body.select(F.to_json(F.struct(*keys, *[F.lit(v).alias(k) for k, v in header.items()], name)).alias("value"))


def review_pack(rows: DataFrame, entries: DataFrame, keys: list[str], keep: str) -> tuple[DataFrame, DataFrame]:
    """(pending, suppressed) rows by the boolean column keep; pending ones need an entry with their keys."""
    return rows.filter(keep).join(entries.select(*keys).distinct(), keys, "left_semi"), rows.filter(~F.col(keep))


def upsert_decisions(old: DataFrame, new: DataFrame, pending: DataFrame, key: str = "event_id") -> DataFrame:
    """old with new's rows in place of its own, for ids that are still pending and statuses that are valid."""
    valid = ("accepted", "rejected", "skipped", "accepted_first_half", "accepted_second_half", "accepted_ranges")
    good = new.filter(F.col("status").isin(*valid)).join(pending.select(key), key, "left_semi")
    return old.join(good.select(key), key, "left_anti").unionByName(good, allowMissingColumns=True)


def audit_lines(events: DataFrame) -> DataFrame:
    """Tab-separated lines: track, segment, start, end, peak."""
    return events.select(F.format_string("%d\t%d\t%.3f\t%.3f\t%.4f", "track_id", "seg", "t0", "t1", "peak").alias("value"))


def next_pending(rows: DataFrame, start: int, key: str = "idx") -> DataFrame:
    """The first undecided row at or after start, wrapping round."""
    n = F.max(key).over(Window.partitionBy("video_id")) + 1
    return rows.withColumn("_n", n).filter("status is null").groupBy("video_id").agg(F.min_by(key, (F.col(key) - start + F.col("_n")) % F.col("_n")).alias(key))


def append_once(rows: DataFrame, batch_id: int, path: str, keys: list[str]) -> None:
    """Append a batch's rows to the log at path, each key once: what another batch has written is left off.

    A batch has a partition of its own, which is written over when the batch comes again, so a batch that is repeated,
    after a failure or by mistake, changes nothing. Made for foreachBatch, whose batches come one after the other.
    """
    fresh = rows.dropDuplicates(keys)
    if _exists(rows.sparkSession, path):
        others = rows.sparkSession.read.parquet(path).filter(F.col("batch_id") != batch_id).select(*keys)
        fresh = fresh.join(others, keys, "left_anti")
    fresh.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def publish(df: DataFrame, root: str) -> None:
    """A new version of what is published at root: written beside the others, complete once its job has committed."""
    versions = [int(r[0].split("=")[1]) for r in _complete(df.sparkSession, root)]
    df.write.parquet(f"{root}/version={max(versions, default=0) + 1}")


def published(spark: SparkSession, root: str) -> DataFrame:
    """The last complete version."""
    last = max((r[0] for r in _complete(spark, root)), key=lambda v: int(v.split("=")[1]))
    return spark.read.parquet(f"{root}/{last}")


def _complete(spark: SparkSession, root: str) -> list:
    """Versions whose job has committed, by the mark that Spark leaves; a name for each version, no rows."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return [(n,) for n in names if n.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
