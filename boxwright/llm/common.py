"""Shared plumbing of the operators: reading tables, cutting lineage, walking Arrow text columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, shared_folder  # noqa: F401

#: Text bytes that a Python worker handles at once (a longer document is a chunk of its own).
CHUNK_BYTES = 512 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_text(col: Column) -> Column:
    """crc32 of an id written as decimal text."""
    return F.crc32(F.encode(col.cast("string"), "UTF-8"))


#: Rows of an Arrow batch that goes to a Python worker, where the session doesn't say: whole texts are held at once.
BATCH_ROWS = 1000
_ROWS_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def mapped(rows: DataFrame, run, schema) -> DataFrame:
    """rows.mapInArrow(run, schema), in batches of BATCH_ROWS unless the session sets a size of its own."""
    if rows.sparkSession.conf.get(_ROWS_CONF) == "10000":  # Spark's default
        rows.sparkSession.conf.set(_ROWS_CONF, str(BATCH_ROWS))
    return rows.mapInArrow(run, schema)


def wrapped(docs: DataFrame, **own: Column) -> DataFrame:
    """docs with each row as one struct _row beside an operator's own columns: no name of the caller's can clash."""
    return docs.select(F.struct(*[docs[f"`{c.replace('`', '``')}`"] for c in docs.columns]).alias("_row"), *[v.alias(k) for k, v in own.items()])


def unwrapped(rows: DataFrame, columns: list[str], **own: Column) -> DataFrame:
    """The caller's columns of wrapped rows, but those that own replaces, and own."""
    kept = [F.col("_row").getField(c).alias(c) for c in columns if c not in own]
    return rows.select(*kept, *[v.alias(k) for k, v in own.items()])


def as_text(col: Column) -> Column:
    """Null counts as the empty text."""
    return F.coalesce(col, F.lit(""))


class Texts:
    """The bytes of some texts, one after the other: buf[starts[i]:ends[i]] is text i."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if column.null_count:
            column = column.fill_null("")
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        _, offsets, data = column.buffers()
        off = np.frombuffer(offsets, np.int64 if wide else np.int32, count=len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.buf = raw[off[0] : off[-1]]
        self.starts, self.ends = off[:-1] - off[0], off[1:] - off[0]
        self.n = len(column)

    def of(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()


def text_chunks(batches, text: str = "text", limit: int = CHUNK_BYTES):
    """(record batch, Texts) of about limit text bytes each, from an iterator of Arrow batches."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(sizes) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
            if hi > lo:
                part = batch.slice(lo, hi - lo)
                yield part, Texts(part.column(text))


def ids_of(batch: pa.RecordBatch, name: str = "doc_id") -> pa.Array:
    return batch.column(name)
