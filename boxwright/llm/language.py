"""Language identification by prediction by partial matching (operator 5).

Each language has a tree of byte contexts of length 0 to ORDER. A byte's code length in a context is that of its
share of the context's counts. A byte not seen there costs the context's escape (method C: distinct bytes over
distinct bytes plus counts) and goes on in the next shorter context, where the bytes seen in the longer one are
excluded, since the escape has told that it is none of them; at last all bytes not seen at all are equally likely. So
the code lengths in any context are those of a distribution. The statistics are frozen after training, and a text's
exact code length in each language is a sum of table entries: what a byte costs depends on the ORDER bytes before.

A-Z is lower-cased. The language with the shortest code wins; the score is its posterior among the languages at a
code length tempered by the text's length.

Training takes at most TRAIN_ROWS rows of each language, those with the smallest hashes of their ids, whole texts.

Defined results: null texts and texts without a letter are 'und' with score 0; a tie goes to the first language
in alphabetical order; without training rows everything is 'und'; rows that repeat are each answered alike; a null
id counts as not held out and never trains; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Texts, as_text, crc32_text, cut, mapped, text_chunks
from .rolling import lower_ascii

ORDER = 3
TRAIN_ROWS = 600


def held_out(id_col: str = "doc_id"):
    return crc32_text(F.col(id_col)) % 4 == 2


def training_sample(docs: DataFrame, id_col: str, rows: int) -> DataFrame:
    """lang and text of a bounded number of rows of each language."""
    pick = docs.filter(~held_out(id_col) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.xxhash64(id_col).alias("h"), F.col(id_col).alias("id"))
    # hashes are spread evenly: a language's rows below a bound that leaves about twice as many as are wanted
    n = pick.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    few = pick.join(F.broadcast(n), "lang").filter((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("n") <= 2 * rows + 50)
    order = Window.partitionBy("lang").orderBy("h", "id")
    chosen = few.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= rows).select("id").distinct()
    return docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.col(id_col).alias("id")).join(F.broadcast(cut(chosen)), "id", "left_semi").select("lang", "text")


def grams(t: Texts) -> list[np.ndarray]:
    """Code of the last k + 1 bytes at each byte, the latest lowest, for k = 0..ORDER; -1 where the text has not so many."""
    low = lower_ascii(t.buf).astype(np.int64)
    place = np.arange(len(low)) - np.repeat(t.starts, t.ends - t.starts)
    out, code = [], np.zeros(len(low), np.int64)
    for k in range(ORDER + 1):
        code = code.copy()
        code[k:] |= low[: len(low) - k] << (8 * k)
        out.append(np.where(place >= k, code, -1))
    return out


def _find(keys: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Row of each wanted key, -1 if there is none."""
    if not len(keys):
        return np.full(len(want), -1)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[at] == want, at, -1)


def _rows(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of a table; row -1 is all zeros."""
    return np.where(at[:, None] >= 0, table[at], 0) if len(table) else np.zeros((len(at), table.shape[1]))


class Model:
    """Frozen counts of every language's tree, and the code lengths of all grams seen in training."""

    def __init__(self, langs: list[str], found: pd.DataFrame):
        self.langs, n = langs, len(langs)
        self.keys, self.counts, self.contexts, self.total, self.kinds, self.rest = [], [], [], [], [], []
        for k in range(ORDER + 1):
            part = found[found.k == k]
            keys = np.unique(part.gram.to_numpy(np.int64))
            counts = np.zeros((len(keys), n), np.int32)
            counts[np.searchsorted(keys, part.gram), part.lang] = part.n
            ctx, where = np.unique(keys >> 8, return_inverse=True)
            total, kinds, again = (np.zeros((len(ctx), n)) for _ in range(3))
            np.add.at(total, where, counts)
            np.add.at(kinds, where, counts > 0)
            if k:  # what the bytes seen here count in the shorter context, where they are excluded
                np.add.at(again, where, np.where(counts > 0, _rows(self.counts[k - 1], _find(self.keys[k - 1], self._shorter(k, keys))), 0))
            for table, x in ((self.keys, keys), (self.counts, counts), (self.contexts, ctx)):
                table.append(x)
            for table, x in ((self.total, total), (self.kinds, kinds), (self.rest, again)):
                table.append(x.astype(np.float32))
        self.bits = self.lengths(ORDER, self.keys[ORDER]).astype(np.float32)

    @staticmethod
    def _shorter(k: int, gram: np.ndarray) -> np.ndarray:
        """The gram without its oldest byte."""
        return gram & ((1 << (8 * k)) - 1)

    def lengths(self, k: int, gram: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each gram in the context before it, for each language."""
        at = _find(self.contexts[k], gram >> 8)
        count = _rows(self.counts[k], _find(self.keys[k], gram))
        total, kinds = _rows(self.total[k], at), _rows(self.kinds[k], at)
        whole = np.maximum(total + kinds, 1)
        escape = np.where(total > 0, -np.log2(np.maximum(kinds, 1) / whole), 0.0)
        return np.where(count > 0, -np.log2(np.maximum(count, 1) / whole), escape + self._excluding(k, gram, at, kinds))

    def _excluding(self, k: int, gram: np.ndarray, at: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Bits in the next shorter context for a byte that was not seen in the one of length k (at, with kinds)."""
        if not len(gram):
            return np.zeros((0, len(self.langs)))
        if not k:
            return np.log2(np.maximum(256 - kinds, 1))
        short = self._shorter(k, gram)
        up = _find(self.contexts[k - 1], short >> 8)
        count = _rows(self.counts[k - 1], _find(self.keys[k - 1], short))
        more = _rows(self.kinds[k - 1], up)
        left, new = _rows(self.total[k - 1], up) - _rows(self.rest[k], at), more - kinds
        whole = np.maximum(left + new, 1)
        escape = np.where(new > 0, -np.log2(np.maximum(new, 1) / whole), 0.0)
        # a count here that is excluded belongs to a byte seen in the longer context, which doesn't come this way
        return np.where(count > 0, -np.log2(np.maximum(count, 1) / whole), escape + self._excluding(k - 1, short, up, more))

    def code_lengths(self, t: Texts) -> np.ndarray:
        """Bits of each text in each language."""
        every = grams(t)
        order = np.minimum(np.arange(len(t.buf)) - np.repeat(t.starts, t.ends - t.starts), ORDER)
        doc = np.repeat(np.arange(t.n), t.ends - t.starts)
        total = np.zeros((t.n, len(self.langs)))
        for k in range(ORDER + 1):
            at = np.flatnonzero(order == k)
            if not len(at):
                continue
            kinds, back = np.unique(every[k][at], return_inverse=True)
            if k == ORDER:
                row = _find(self.keys[k], kinds)
                bits = _rows(self.bits, row)
                bits[row < 0] = self.lengths(k, kinds[row < 0])
            else:
                bits = self.lengths(k, kinds)
            for j in range(len(self.langs)):
                total[:, j] += np.bincount(doc[at], weights=bits[:, j][back], minlength=t.n)
        return total


def train(docs: DataFrame, id_col: str = "doc_id", rows: int = TRAIN_ROWS) -> Model | None:
    def gram_counts(batches):
        for batch, t in text_chunks(batches):
            name, number = np.unique(np.asarray(batch.column("lang").to_pylist(), object), return_inverse=True)
            of = np.repeat(number, t.ends - t.starts)
            for k, g in enumerate(grams(t)):
                ok = g >= 0
                kinds, n = np.unique((of[ok] << 32) | g[ok], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(name[kinds >> 32].tolist(), pa.string()), pa.array(np.full(len(n), k)), pa.array(kinds & 0xFFFFFFFF), pa.array(n)], ["lang", "k", "gram", "n"])

    # bounded by the sample: the grams of at most TRAIN_ROWS texts of each language
    sample = cut(training_sample(docs, id_col, rows))
    found = mapped(sample, gram_counts, "lang string, k long, gram long, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(found):
        return None
    langs = sorted(found.lang.unique())
    found["lang"] = found.lang.map({x: i for i, x in enumerate(langs)})
    return Model(langs, found)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score for each row; only the text is looked at."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch, t in text_chunks(batches):
            if m is None:
                best, score, names = np.zeros(t.n, np.int64), np.zeros(t.n), np.array(["und"], object)
            else:
                bits, names = m.code_lengths(t), np.array(m.langs, object)
                best = bits.argmin(axis=1)
                size = np.maximum(t.ends - t.starts, 1)
                gap = (bits - bits.min(axis=1, keepdims=True)) / np.sqrt(size)[:, None]
                score = 1 / np.exp2(-gap).sum(axis=1)
            letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            pred = np.where(letters, names[best], "und")
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(pred.tolist(), pa.string()), pa.array(np.where(letters, score, 0.0))], ["id", "held_out", "lang_pred", "score"])

    letters = F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), letters.alias("letters"), as_text(F.col(text)).alias("text"))
    return mapped(rows, run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
