"""Readers of stored documents: one JSON document a file, on one line or many, with or without a byte order mark.

Each kind has its schema. Documents that don't fit it are kept apart with their text, so that none is lost and none
ends the job. Where no file of a kind is there, an optional one is an empty table and a required one an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut

_BAD = "_broken"
#: Schemas of the kinds of documents, by name; keys that aren't listed are not read (fixed names).
KINDS = {
    "identity_clusters": "clusters array<struct<identity_id:string,track_ids:array<long>,start_time:double,end_time:double>>",
    "final_events": "events array<struct<event_id:string,track_id:long,tier:string,start_frame:long,end_frame:long>>",
    "mask_timeline": "proposals array<struct<proposal_id:string,track_id:long,start_frame:long,end_frame:long>>",
    "event_segment_map": "events array<struct<event_id:string,track_id:long,start_frame:long,end_frame:long>>",
}
#: Extensions of videos (fixed values).
VIDEOS = ("mp4", "mov", "mkv", "avi", "m4v", "ts", "flv", "wmv")
REQUIRED = ("identity_clusters", "final_events")


def _files(spark: SparkSession, path: str) -> bool:
    """Whether any file lies at path (a pattern or a folder); names only."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return bool(found)


@contextmanager
def listing(spark: SparkSession) -> Iterator[None]:
    """Folders are listed in a few tasks for each core, while readers are made; Spark's default is a task for each folder."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    old = spark.conf.get(name)
    spark.conf.set(name, 4 * spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        spark.conf.set(name, old)


def read_documents(spark: SparkSession, path: str, kind: str, keys: str = "video_id long", required: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, broken) of a kind below path, whose folders may name the columns of keys.

    documents has keys and the fields of the kind, null where a document leaves them out. broken has keys, path and
    text: what is no JSON, no object or has a field of another type; files of blanks have an empty text. Spark's scans
    skip files of no bytes, so these are in neither and count as missing.
    """
    required = kind in REQUIRED if required is None else required
    names = [k.split()[0] for k in keys.split(", ")] if keys else []
    schema = f"{KINDS[kind]}, {_BAD} string" + (f", {keys}" if keys else "")
    if not _files(spark, path):
        if required:
            raise FileNotFoundError(f"no {kind} below {path}")
        every = spark.createDataFrame([], schema + ", path string")
    else:
        with listing(spark):
            parsed = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD).json(path)
            files = spark.read.format("binaryFile").load(path)
        # written once: the text of broken ones can't be read alone, and both results come from one parse
        every = cut(parsed.withColumn("path", F.col("_metadata.file_path")))
        blank = files.select(*[F.col(k) for k in names], F.col("_metadata.file_path").alias("path"))
        blank = blank.join(every.select("path").distinct(), "path", "left_anti")
        every = every.unionByName(blank.withColumn(_BAD, F.lit("")), allowMissingColumns=True)
    fields = [c for c in every.columns if c not in (*names, _BAD, "path")]
    return every.filter(F.col(_BAD).isNull()).select(*names, *fields), every.filter(F.col(_BAD).isNotNull()).select(*names, "path", F.col(_BAD).alias("text"))


def keyed(documents: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    """Rows of a kind's list beside keys: the last one of an id, as in a map; null lists give none."""
    name = KINDS[kind].split()[0]
    rows = documents.select(*keys, F.posexplode(name).alias("_at", "r")).select(*keys, "_at", "r.*")
    id_ = rows.columns[len(keys) + 1]
    last = rows.groupBy(*keys, id_).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (*keys, id_, "_at")]), "_at").alias("r"))
    return last.select(*keys, id_, "r.*")


def status_by_key(expected: DataFrame, documents: DataFrame, broken: DataFrame, keys: list[str]) -> DataFrame:
    """expected (keys) with status: read, broken (no document of the key could be read) or missing."""
    found = documents.select(*keys, F.lit(2).alias("s")).unionByName(broken.select(*keys, F.lit(1).alias("s"))).groupBy(*keys).agg(F.max("s").alias("s"))
    return expected.join(found, keys, "left").select(*keys, F.when(F.col("s") == 2, "read").when(F.col("s") == 1, "broken").otherwise("missing").alias("status"))


def discover(spark: SparkSession, root: str, extensions: tuple[str, ...] = VIDEOS) -> DataFrame:
    """(path, name, length) of files below root, whatever their depth, with one of the extensions in any case.

    Contents aren't read; files of no bytes aren't listed. Rows come in the order of their paths.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length")
    return f.filter(F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).isin(*extensions)).orderBy("path")
