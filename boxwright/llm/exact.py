"""Exact deduplication by two-pass Bloom filtering (operator 6), DataFrame functions only.

Pass 1 hashes every normalised text and fills a counting Bloom filter: which bits did at least two rows hit?
Pass 2 tests each row against it. Rows with a bit that nobody else hit are surely unique and pass straight
through, without a shuffle; only the possibly repeated ones are grouped by their SHA-256.

The filter grows with the rows, BITS_PER_ROW for each, and is cut into ranges of the digest: a range has RANGE_BITS
bits, at most RANGE_BITS / 64 words of eight bytes in arrays of ROW_WORDS, and the filters of PASS ranges are broadcast
to a pass over the written digests of these ranges. So no broadcast grows with the input. At most RANGES ranges are
made (about 270 million rows); with more rows the filter gets fuller and lets more unique rows into the shuffle. The
grouping is exact in any case.

A text that a third of the rows hold is no hot key: its ids are aggregated in SALTS parts, and what is found goes
back to the parts.

Defined results: null text counts as empty and empty texts equal each other; rows that agree in text and id are
one document written twice, one of them stays; a null id sorts after all others; an empty table gives an empty
table; other columns of the input pass through untouched, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_text, cut, unwrapped, wrapped

BITS_PER_ROW = 16
RANGE_BITS, RANGES = 1 << 26, 64
#: Ranges of one pass (8 MB of filter each), and verdicts that are broadcast (about 100 bytes each).
PASS, VERDICTS = 8, 400_000
ROW_WORDS = 512
HASHES = 2
SALTS = 64


def normalised(text: Column) -> Column:
    """Each run of blanks becomes one space; null counts as empty."""
    return F.regexp_replace(as_text(text), "[\\x20\\x09-\\x0D]+", " ")


def _part(digest: Column, first: int, digits: int) -> Column:
    return F.conv(F.substring(digest, first, digits), 16, 10).cast("long")


def _slots(digest: Column, bits: int) -> list[Column]:
    """Bit numbers of a digest (hex) in its range: 40 of its bits for each hash function."""
    return [F.pmod(_part(digest, 1 + 10 * i, 10), F.lit(bits)) for i in range(HASHES)]


def _range(digest: Column, ranges: int) -> Column:
    return F.pmod(_part(digest, 41, 10), F.lit(ranges)) if ranges > 1 else F.lit(0).cast("long")


def _bits(digests: DataFrame, bits: int, ranges: int) -> DataFrame:
    """(range, slot): the bits of each digest."""
    return digests.select(_range(F.col("sha"), ranges).alias("range"), F.explode(F.array_distinct(F.array(*_slots(F.col("sha"), bits)))).alias("slot"))


def _pages(slots: DataFrame) -> DataFrame:
    """A filter as rows (range, page, words) of its set bits (range, slot), 64 in a word."""
    words = slots.groupBy("range", F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("mask"))
    pages = words.groupBy("range", F.floor(F.col("word") / ROW_WORDS).alias("page")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("word") % ROW_WORDS, "mask"))).alias("m"))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(ROW_WORDS - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    return pages.select("range", "page", every.alias("words"))


def twice_hit(digests: DataFrame, bits: int, ranges: int = 1) -> DataFrame:
    """The filter's pages: the bits that two or more of the digests hit."""
    return _pages(_bits(digests, bits, ranges).groupBy("range", "slot").count().filter("count > 1"))


def _plan(rows: int) -> tuple[int, int]:
    """Bits of a range and number of ranges for so many rows."""
    want = max(rows * BITS_PER_ROW, 1 << 16)
    ranges = min(RANGES, max(1, -(-want // RANGE_BITS)))
    return min(RANGE_BITS, 1 << (want - 1).bit_length()) if ranges == 1 else RANGE_BITS, ranges


def flagged(docs: DataFrame, text: str = "text", bits: int | None = None, ranges: int | None = None) -> DataFrame:
    """docs with text_sha256 and maybe_repeated (false: no other row has this text)."""
    sha = F.sha2(normalised(F.col(text)), 256)
    out = _tested(wrapped(docs, sha=sha), cut(docs.select(sha.alias("sha"))), bits, ranges)
    return unwrapped(out, docs.columns, text_sha256=F.col("sha"), maybe_repeated=F.col("maybe_repeated"))


def _tested(rows: DataFrame, digests: DataFrame, bits: int | None, ranges: int | None) -> DataFrame:
    """rows (with sha) and maybe_repeated (false: no other row of digests, a written table, has this sha)."""
    sized = _plan(digests.count())
    bits, ranges = bits or sized[0], ranges or sized[1]
    return _probed(rows, cut(twice_hit(digests, bits, ranges)), bits, ranges)


def _probed(rows: DataFrame, pages: DataFrame, bits: int, ranges: int) -> DataFrame:
    """rows (with sha) and maybe_repeated: all their bits are set in the filter. A pass takes PASS ranges at once."""
    where = lambda bit: _range(F.col("sha"), ranges) * (1 << 32) + F.floor(F.shiftright(bit, 6) / ROW_WORDS)

    def one(first: int) -> DataFrame:
        mine, out, maybe = pages, rows, F.lit(True)
        if ranges > PASS:
            mine = pages.filter(F.col("range").between(first, first + PASS - 1))
            out = rows.filter(_range(F.col("sha"), ranges).between(first, first + PASS - 1))
        for i, slot in enumerate(_slots(F.col("sha"), bits)):
            side = F.broadcast(mine.select((F.col("range") * (1 << 32) + F.col("page")).alias(f"_page{i}"), F.col("words").alias(f"_words{i}")))
            out = out.join(side, where(slot) == F.col(f"_page{i}"), "left")
            word = F.try_element_at(f"_words{i}", (F.shiftright(slot, 6) % ROW_WORDS + 1).cast("int"))
            maybe = maybe & F.coalesce(F.getbit(word, (slot % 64).cast("int")) == 1, F.lit(False))
        return out.select(*rows.columns, maybe.alias("maybe_repeated"))

    return reduce(DataFrame.unionByName, [one(k) for k in range(0, ranges, PASS)])


def _digests(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, sha) of every row, written once: texts are hashed once for the filter and the groups."""
    return cut(docs.select(F.col(id_col).alias("id"), F.sha2(normalised(F.col(text)), 256).alias("sha")))


def _groups(repeated: DataFrame) -> DataFrame:
    """(sha, id, n, keep_id, group_size) of rows (id, sha): rows that agree in both are counted as n."""
    again = repeated.groupBy("sha", "id").agg(F.count(F.lit(1)).alias("n")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    parts = again.groupBy("sha", "salt").agg(F.min("id").alias("low"), F.sum("n").alias("size"))
    whole = parts.groupBy("sha").agg(F.min("low").alias("keep_id"), F.sum("size").alias("group_size"))
    back = parts.select("sha", "salt").join(whole, "sha")
    return again.join(back, ["sha", "salt"]).select("sha", "id", "n", "keep_id", "group_size")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", bits: int | None = None, ranges: int | None = None) -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, text_sha256."""
    digests = _digests(docs, id_col, text)
    marked = cut(_tested(digests, digests, bits, ranges))
    alone = marked.filter("not maybe_repeated").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    groups = _groups(marked.filter("maybe_repeated").select("id", "sha"))
    # rows that agree in text and id were counted; they are written out again, and one of them stays
    spread = groups.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    rest = spread.select("id", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"), "sha")
    return alone.unionByName(rest).withColumnsRenamed({"id": id_col, "sha": "text_sha256"})


def _verdicts(digests: DataFrame, bits: int | None, ranges: int | None) -> DataFrame:
    """(sha, id, stays), written, of the rows that not simply stay: false for those that go, true for one of several that are alike in both."""
    groups = _groups(_tested(digests, digests, bits, ranges).filter("maybe_repeated").select("id", "sha"))
    stays = F.col("id").eqNullSafe(F.col("keep_id"))
    return cut(groups.filter(~stays | (F.col("n") > 1)).select("sha", "id", stays.alias("stays")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", bits: int | None = None, ranges: int | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns: the smallest id of each group of equal texts.

    docs is read twice whatever the number of ranges: for the written digests, on which alone all is decided, and for
    the rows, which meet the verdicts. Up to VERDICTS verdicts are broadcast; more are a filter first, so that only rows
    that may have one shuffle (docs is then read once more, and once more if rows are alike in text and id).
    """
    digests = _digests(docs, id_col, text)
    verdicts = _verdicts(digests, bits, ranges)
    count = verdicts.count()
    side = verdicts.select(F.col("sha").alias("_sha"), F.col("id").alias("_id"), "stays")
    met = lambda rows, side: rows.join(side, (F.col("sha") == F.col("_sha")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    rows = wrapped(docs, sha=F.sha2(normalised(F.col(text)), 256), id=F.col(id_col))
    parts = []
    if count <= VERDICTS:
        judged = met(rows, F.broadcast(side))
    else:
        size, n = _plan(count)
        n = min(n, PASS)
        probed = _probed(rows, cut(_pages(_bits(verdicts, size, n).distinct())), size, n)
        parts.append(probed.filter("not maybe_repeated").select("_row"))
        judged = met(probed.filter("maybe_repeated"), side)
    parts.append(judged.filter("stays is null").select("_row"))
    if not verdicts.filter("stays").isEmpty():
        parts.append(judged.filter("stays").dropDuplicates(["sha", "id"]).select("_row"))
    return unwrapped(reduce(DataFrame.unionByName, parts), docs.columns)
