"""Ranked lexical search over a two-level quantised index (operator 11).

The index has one row for each document, with whole term lists, written as a table that is read by columns. Level 1:
terms and one byte for each, the term's impact rounded up to a multiple of STEP. Level 2: length and occurrences.

A byte b says that the impact lies between (b - 1) * STEP + 1 and b * STEP, so level 1 alone gives an upper and a lower
bound of each document's score. Queries come in blocks; tasks sum both bounds of all their documents for a block,
document by document, without a shuffle, and hand on what reaches the k-th lower bound that they have seen.
Over all tasks the k-th lower bound of each query is found, and every document whose upper bound reaches it
is read from level 2 and scored in exact integers. No document that could be among the first k is left off.

Scores: w = floor(1000 * ln((2N + 2) / (2df + 1))) for each term, impact = 1000000000 * tf div (1000 * tf + 8 * m) with
m = 25 + (75 * n * N) div L; a score is the sum of w * impact over the query's terms, repeats included. N counts the
documents with a term, L their terms, n a document's terms, df the documents that hold the term.

Defined results: terms are runs of ASCII letters and digits and of anything beyond ASCII, of which only A-Z are
lower-cased; null and empty texts have none and neither are found nor find; equal scores go by id (null last), then
by the row's place; documents that repeat are found each; rows of queries are queries each, whatever their ids;
scores of 0 are left off; very long texts are one row; other columns are ignored; empty tables give an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Texts, as_text, cut, mapped, text_chunks

#: 255 steps cover all impacts, which are below 1,000,000.
STEP = 3922
#: Queries of a block, and (document, query) bounds that a task holds at once.
BLOCK, AT_ONCE = 256, 1 << 21
#: (query, document) pairs that are sent to all tasks for rescoring; more meet level 2 in a shuffle.
BROADCAST = 500_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _bounds(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and text of each term."""
    on = np.concatenate((_TERM[t.buf], [False]))
    begin = on.copy()
    begin[1:] &= ~on[:-1]
    begin[t.starts[t.starts < t.ends]] |= on[t.starts[t.starts < t.ends]]
    stop = np.zeros(len(on) + 1, bool)  # at the byte behind a term
    stop[1:-1] = on[:-1] & ~on[1:]
    stop[t.ends[t.starts < t.ends]] |= on[t.ends[t.starts < t.ends] - 1]
    at = np.flatnonzero(begin)
    return at, np.flatnonzero(stop), np.searchsorted(t.ends, at, side="right")


def term_counts(t: Texts) -> np.ndarray:
    """Terms of each text, with repeats."""
    return np.bincount(_bounds(t)[2], minlength=t.n)


def term_lists(t: Texts) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms of each text, one text after the other, how often each occurs, and the text of each."""
    at, stop, text = _bounds(t)
    size = stop - at
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    data = _FOLD[t.buf[np.repeat(at - ends + size, size) + np.arange(total)]]
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    coded = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
    width = max(len(coded.dictionary), 1)
    key, count = np.unique(text * width + coded.indices.to_numpy().astype(np.int64), return_counts=True)
    return coded.dictionary.take(pa.array(key % width)), count, key // width


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """The integer impact of a term that occurs tf times in a document of n terms."""
    m = 25 + (75 * n * docs) // max(length, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def build_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, int, int]:
    """The index (row, id, n, terms, impacts, counts) as a written table, N and L.

    Every document with a term is in it, with all of them. Texts are read twice: first for N and L, on which the
    impacts rest.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    whole = docs.select(as_text(F.col(text)).alias("text"))

    def lengths(batches):
        for _, t in text_chunks(batches, "text"):
            n = term_counts(t)
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], ["docs", "length"])

    total = mapped(whole, lengths, "docs long, length long").agg(F.sum("docs"), F.sum("length")).first()
    many, length = total[0] or 0, total[1] or 0

    def run(batches):
        for batch, t in text_chunks(batches, "text"):
            terms, count, doc = term_lists(t)
            n = np.bincount(doc, weights=count, minlength=t.n).astype(np.int64)
            some = np.flatnonzero(n)
            byte = -(-impacts(count, n[doc], many, length) // STEP)
            ends = np.cumsum(np.bincount(doc, minlength=t.n)[some])
            offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, terms.cast(pa.string()))
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, offsets.buffers()[1], pa.py_buffer(byte.astype(np.uint8))])
            which = pa.array(some)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), pa.array(n[some]), lists, packed, pa.ListArray.from_arrays(offsets, pa.array(count.astype(np.int32)))], ["row", "id", "n", "terms", "impacts", "counts"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), as_text(F.col(text)).alias("text"))
    made = mapped(rows, run, f"row long, id {kind}, n long, terms array<string>, impacts binary, counts array<int>")
    return cut(made), many, length


def query_terms(queries: DataFrame, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """(query, item, block, term, times), written: query numbers the rows from 0 and block holds BLOCK of them."""
    kind = queries.schema[id_col].dataType.simpleString()
    rows = cut(queries.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("item"), as_text(F.col(text)).alias("text")))

    def run(batches):
        for batch, t in text_chunks(batches, "text"):
            terms, count, doc = term_lists(t)
            which = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), terms.cast(pa.string()), pa.array(count.astype(np.int64))], ["row", "item", "term", "times"])

    # the row's number is its partition's first number, from counts by partition, and its place there
    part, place = F.shiftright("row", 33), F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("part")).count()
    firsts = sizes.withColumn("first", F.sum("count").over(Window.orderBy("part")) - F.col("count")).select("part", "first")
    terms = mapped(rows, run, f"row long, item {kind}, term string, times long").withColumns({"part": part, "place": place})
    numbered = terms.join(firsts, "part").withColumn("query", F.col("first") + F.col("place"))
    return cut(numbered.select("query", "item", F.floor(F.col("query") / BLOCK).alias("block"), "term", "times"))


class _Block:
    """A block of queries as the tasks hold it: for each term, the queries with it and their weights."""

    def __init__(self, rows: list, weight: dict[str, int]):
        self.terms = sorted(weight)
        code = {t: i for i, t in enumerate(self.terms)}
        self.queries = np.asarray(sorted({r.query for r in rows}), np.int64)
        number = {q: i for i, q in enumerate(self.queries.tolist())}
        by = sorted((code[r.term], number[r.query], r.times * weight[r.term]) for r in rows)
        at, self.query, self.gain = (np.asarray(x, np.int64) for x in zip(*by, strict=True))
        self.size = np.bincount(at, minlength=len(self.terms))
        self.start = np.cumsum(self.size) - self.size

    def bounds(self, doc: np.ndarray, code: np.ndarray, byte: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds, documents by queries, in whole numbers that doubles hold exactly."""
        size = self.size[code]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.start[code] - ends + size, size) + np.arange(total)
        key = np.repeat(doc, size) * len(self.queries) + self.query[at]
        gain, b = self.gain[at].astype(np.float64), np.repeat(byte, size)
        high = np.bincount(key, weights=gain * (b * STEP), minlength=n * len(self.queries))
        low = np.bincount(key, weights=gain * np.maximum((b - 1) * STEP + 1, 0), minlength=n * len(self.queries))
        return low.reshape(n, -1), high.reshape(n, -1)


def _hits(batch: pa.RecordBatch, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document in the batch, code and place in the flat list of each of its terms that the block knows."""
    lists = batch.column("terms")
    code = pa.compute.index_in(lists.flatten(), value_set=terms)
    known = code.is_valid().to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False))
    place = np.flatnonzero(known)
    return doc[place], code.drop_null().to_numpy().astype(np.int64), place


def _candidates(index: DataFrame, block: _Block, k: int) -> DataFrame:
    """(query, row, low, high) of all documents that reach the k-th lower bound of their task."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        terms, many = pa.array(block.terms, pa.string()), len(block.queries)
        best = np.zeros((k, many))  # the k best lower bounds so far
        held: list[tuple[np.ndarray, ...]] = []

        def alive(x: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
            on = x[3] >= best.min(axis=0)[x[0]]
            return tuple(c[on] for c in x)

        def out(xs) -> pa.RecordBatch:
            q, row, low, high = (np.concatenate(c) for c in zip(*xs, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(block.queries[q]), pa.array(row), pa.array(low.astype(np.int64)), pa.array(high.astype(np.int64))], ["query", "row", "low", "high"])

        step = max(1, AT_ONCE // many)
        for whole in batches:
            for i in range(0, len(whole), step):
                batch = whole.slice(i, step)
                doc, code, place = _hits(batch, terms)
                flat = np.frombuffer(b"".join(batch.column("impacts").to_pylist()), np.uint8)
                low, high = block.bounds(doc, code, flat[place].astype(np.int64), len(batch))
                both = np.concatenate((best, low))
                best = np.partition(both, len(both) - k, axis=0)[-k:]
                d, q = np.nonzero((high > 0) & (high >= best.min(axis=0)))
                held.append((q, batch.column("row").to_numpy()[d], low[d, q], high[d, q]))
                if sum(len(x[0]) for x in held) > AT_ONCE:
                    held = [alive(x) for x in held]
                    if sum(len(x[0]) for x in held) > AT_ONCE // 2:  # many equal ones: they are handed on at once
                        yield out(held)
                        held = []
        if held:
            yield out([alive(x) for x in held])

    return mapped(index.select("row", "terms", "impacts"), run, "query long, row long, low long, high long")


def _document_counts(index: DataFrame, terms: list[str]) -> dict[str, int]:
    """In how many documents each term is."""

    def run(batches):
        known, sums = pa.array(terms, pa.string()), np.zeros(len(terms), np.int64)
        for batch in batches:
            sums += np.bincount(_hits(batch, known)[1], minlength=len(terms))
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["code", "df"])

    found = mapped(index.select("terms"), run, "code long, df long").groupBy("code").agg(F.sum("df").alias("df")).collect()
    return {terms[r.code]: r.df for r in found}


def search(index: DataFrame, many: int, length: int, queries: DataFrame, k: int = 10, item_col: str = "item_id", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """item, rank, id, score, candidates: the k best documents of each query by exact score.

    queries are taken in blocks of BLOCK; a block's terms and weights are what the driver holds at a time.
    candidates counts the documents of the query that were scored exactly.
    """
    spark = index.sparkSession
    asked = query_terms(queries, item_col, text)
    kinds = f"{item_col} {asked.schema['item'].dataType.simpleString()}, rank int, {id_col} {index.schema['id'].dataType.simpleString()}, score long, candidates long"
    found = None
    for number in sorted(r.block for r in asked.select("block").distinct().collect()):
        mine = asked.filter(F.col("block") == number)
        rows = mine.collect()
        df = _document_counts(index, sorted({r.term for r in rows}))
        weight = {t: math.floor(1000 * math.log((2 * many + 2) / (2 * n + 1))) for t, n in df.items()}
        rows = [r for r in rows if r.term in weight]
        if not rows:
            continue
        block = _Block(rows, weight)
        reach = cut(_candidates(index, block, k))
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("low")))
        kth = reach.withColumn("place", place).filter(F.col("place") <= k).groupBy("query").agg(F.when(F.count("low") == k, F.min("low")).otherwise(0).alias("least"))
        picked = cut(reach.join(kth, "query").filter("high >= least").select("query", "row"))
        weights = spark.createDataFrame(list(weight.items()), "term string, w long")
        gains = mine.join(weights, "term").select("query", "item", "term", (F.col("times") * F.col("w")).alias("gain"))
        exact = _rescored(picked, index, gains, many, length)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
        ranked = exact.filter("score > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        sizes = picked.groupBy("query").agg(F.count("row").alias("candidates"))
        part = ranked.join(sizes, "query").select(F.col("item").alias(item_col), F.col("rank").cast("int"), F.col("id").alias(id_col), "score", "candidates")
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], kinds)


def _rescored(picked: DataFrame, index: DataFrame, gains: DataFrame, many: int, length: int) -> DataFrame:
    """(query, item, row, id, score) of picked (query, row) from level 2, in whole numbers."""
    side = F.broadcast(picked) if picked.count() <= BROADCAST else picked
    full = index.select("row", "id", "n", "terms", "counts").join(side, "row")
    each = full.select("query", "row", "id", "n", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("query", "row", "id", "n", F.col("x.terms").alias("term"), F.col("x.counts").cast("long").alias("tf"))
    m = f"(25 + (75L * n * {many}L) div {max(length, 1)}L)"
    impact = F.expr(f"(1000000000L * tf) div (1000L * tf + 8L * {m})")
    return each.join(gains, ["query", "term"]).groupBy("query", "item", "row", "id").agg(F.sum(F.col("gain") * impact).alias("score"))
