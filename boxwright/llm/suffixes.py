"""Suffix-array deduplication (operator 10): remove every byte of a repeated string of LENGTH bytes.

1. Candidates, without loss. A window of LENGTH bytes is keyed by the smallest hash of the GRAM-byte strings inside
   it. Equal windows have equal keys, so a key that occurs in one stretch of one text only needs no more work.
   Consecutive windows whose smallest string is at one place are a stretch (about 70 windows, none twice); only
   keys and hashes of stretches shuffle.
2. Equal stretches are one, with a count; those counted twice are repeated as a whole.
3. Keys that hold different stretches get their texts, grouped by a hash of the key, and each group is sorted by
   the difference-cover algorithm: triples at places not divisible by 3 are sorted and named, the names recursed
   on until a name covers LENGTH bytes, the remaining suffixes merged in, and adjacent prefixes compared.
   Since keys split the suffixes by content, a group's order decides all of its own prefixes, and no group is
   larger than its keys' distinct stretches. A key with more than HOT distinct stretches is decided by the hashes of
   its single windows instead, which Spark aggregates in parts.
4. Repeated windows go back to all texts that hold their stretch, and are cut out there.

Hashes of stretches are 128 bits with their key. Groups of copies of any size never meet in one task: counts are
aggregated in parts, and the join that brings results back can be split by Spark.

Defined results: null counts as empty; ids should be unique: rows that agree in id and text are judged as two texts;
a null id takes part like any other; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, as_text, cut, mapped, text_chunks
from .rolling import Prefix, U, mix

LENGTH, GRAM = 200, 64
HOT = 20_000
#: Stretches of which more than OFTEN are equal are joined by broadcast, if they are NEED kinds at most.
OFTEN, NEED = 500, 100_000
#: More than the windows of any stretch; places are packed with it.
STRETCH = 4096
_MIX = U(0xA24BAED4963EE407)


def window_keys(grams: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The smallest gram hash of every window of length bytes (windows across texts are not sorted out here)."""
    least = grams
    span = length - gram + 1
    if len(least) < span:
        return np.zeros(0, U)
    width = 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = span - width
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def stretches(t: Texts, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with one key: key, hash of the bytes, first byte in the buffer, windows, text number."""
    prefix = Prefix(t.buf)
    grams = prefix.windows(gram, gram)
    keys = window_keys(grams, length, gram)
    sizes = np.maximum(t.ends - t.starts - length + 1, 0)
    doc = np.repeat(np.arange(t.n), sizes)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + t.starts[doc]
    if not len(at):
        return np.zeros(0, U), np.zeros(0, U), at, at, doc
    k = keys[at]
    # the leftmost smallest gram leaves the window: what follows is another stretch, so none repeats inside itself
    leaves = grams[at] == k
    new = np.ones(len(at), bool)
    new[1:] = (k[1:] != k[:-1]) | (doc[1:] != doc[:-1]) | leaves[:-1]
    first = np.flatnonzero(new)
    run = np.diff(np.concatenate((first, [len(at)])))
    start = at[first]
    return mix(k[first]), prefix.of(start, start + run + length - 1), start, run, doc[first]


def suffix_ranks(text: np.ndarray, cover: int) -> np.ndarray:
    """Rank of every suffix of text (values from 1) by its first `cover` symbols at least, ties having one rank.

    The difference-cover algorithm modulo 3; the recursion ends when names cover enough or all differ.
    """
    n = len(text)
    s = np.concatenate((text.astype(np.int64), [0, 0, 0]))
    i12 = np.flatnonzero(np.arange(n + 1) % 3 != 0)
    one, two = i12[i12 % 3 == 1], i12[i12 % 3 == 2]
    i12 = np.concatenate((one, two))
    # names of triples, by their order; pairs are numbers as they stand while a triple of them fits 62 bits
    base = int(s.max()) + 1
    pair = s[:-1] * base + s[1:]
    if base**2 * max(base, n + 2) >= 1 << 62:
        pair = np.unique(pair, return_inverse=True)[1]
    name = np.unique(pair[i12] * base + s[i12 + 2], return_inverse=True)[1] + 1
    if cover > 3 and len(name) and name.max() < len(name):
        inner = suffix_ranks(np.concatenate((name[: len(one)], [0], name[len(one) :])), -(-cover // 3))
        name = np.unique(np.concatenate((inner[: len(one)], inner[len(one) + 1 :])), return_inverse=True)[1] + 1
    rank12 = np.zeros(n + 4, np.int64)
    rank12[i12] = name
    i0 = np.arange(0, n, 3)
    top = int(name.max()) + 1 if len(name) else 1
    # a suffix at 0 mod 3 against one at 1 mod 3: first symbol, then the rank one on; against 2 mod 3: two symbols
    k0, k1 = s[i0] * top + rank12[i0 + 1], s[one] * top + rank12[one + 1]
    q0, q2 = pair[i0] * top + rank12[i0 + 2], pair[two] * top + rank12[two + 2]
    o0, o1, o2 = np.argsort(k0), np.argsort(k1), np.argsort(q2)
    i0, k0, q0, one, k1, two, q2 = i0[o0], k0[o0], q0[o0], one[o1], k1[o1], two[o2], q2[o2]
    # merged places: a suffix's place is the number of suffixes before it, ties sharing the lower place
    place = np.zeros(n + 4, np.int64)
    place[i0] = np.searchsorted(k0, k0) + np.searchsorted(k1, k0) + np.searchsorted(q2, q0)
    place[i12] = np.cumsum(np.bincount(name, minlength=1))[name - 1]
    place[one] += np.searchsorted(k0, k1)
    place[two] += np.searchsorted(np.sort(q0), q2)
    return place[:n]


def repeated_windows(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each distinct string: which of its windows of length bytes occur anywhere else among the strings."""
    sizes = np.array([len(p) for p in parts], np.int64)
    raw = np.frombuffer(b"\0".join(parts), np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    text = raw.astype(np.int64) + 2
    text[(starts + sizes)[:-1]] = 1
    rank = suffix_ranks(text, length)
    windows = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(parts)), windows)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + starts[owner]
    order = at[np.argsort(rank[at], kind="stable")]
    # adjacent prefixes, by two hashes of their bytes
    same = np.ones(max(len(order) - 1, 0), bool)
    for seed in (11, 23):
        h = Prefix(raw, seed).windows(length)[order]
        same &= h[1:] == h[:-1]
    twice = np.zeros(len(raw) + 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    flags = twice[at]
    return np.split(flags, np.cumsum(windows)[:-1])


def _ranges(flags: np.ndarray) -> list[int]:
    """Maximal runs of true as a flat list start, end, start, end..."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge.tolist()


def _stretch_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for batch, t in text_chunks(batches):
            key, h, start, n, doc = stretches(t, length, gram)
            cols = [pa.array(key.view(np.int64)), pa.array(h.view(np.int64)), batch.column("uid").take(pa.array(doc)), pa.array((start - t.starts[doc]) * (STRETCH * 2) + n)]
            yield pa.RecordBatch.from_arrays(cols, ["key", "h", "uid", "place"])

    # place holds the first byte and the number of windows
    return mapped(docs, run, "key long, h long, uid long, place long")


def _cut_out(length: int):
    """Texts and the places wanted of them -> (key, h, part)."""

    def run(batches):
        for batch in batches:
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                b = text.encode()
                rows = [(w["key"], w["h"], b[w["place"] // (STRETCH * 2) :][: w["place"] % (STRETCH * 2) + length - 1], w["hot"]) for w in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.bool_())], ["key", "h", "part", "hot"])

    return run


def may_share(parts: list[bytes], keys: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Stretches that another of their key may share a window with.

    Equal windows hold the smallest gram at one place, so their stretches agree in length - gram bytes around it and
    in half of those on one side at least. Hashes of the gram with either half show which do.
    """
    half = (length - gram + 1) // 2
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    buf = np.frombuffer(b"".join(parts), np.uint8)
    prefix = Prefix(buf)
    owner = np.repeat(np.arange(len(parts)), sizes)[: max(len(buf) - gram + 1, 0)]
    at = np.flatnonzero(mix(prefix.windows(gram, gram)) == keys[owner])
    at = at[at + gram <= ends[owner[at]]]
    who, first = np.unique(owner[at], return_index=True)
    place = at[first]
    out = np.zeros(len(parts), bool)
    for lo, hi in ((place - half, place + gram), (place, place + gram + half)):
        ok = (lo >= starts[who]) & (hi <= ends[who])
        h = mix(prefix.of(lo[ok], hi[ok]) ^ mix(keys[who[ok]]))
        _, back, n = np.unique(h, return_inverse=True, return_counts=True)
        out[who[ok][n[back] > 1]] = True
    return out


def _sort_group(length: int, gram: int):
    def run(key, table):
        keys = table.column("key").to_numpy().view(U)
        table = table.filter(pa.array(may_share(table.column("part").to_pylist(), keys, length, gram)))
        parts = table.column("part").to_pylist()
        if not parts:
            return pa.table({"key": table.column("key"), "h": table.column("h"), "ranges": pa.array([], pa.list_(pa.int32()))})
        found = [_ranges(f) for f in repeated_windows(parts, length)]
        out = pa.table({"key": table.column("key"), "h": table.column("h"), "ranges": pa.array(found, pa.list_(pa.int32()))})
        return out.filter(pa.array([bool(f) for f in found]))

    return run


def _window_hashes(length: int):
    """Single windows of hot keys' stretches: 128-bit hash and place."""

    def run(batches):
        for batch in batches:
            t = Texts(batch.column("part").cast(pa.binary()))
            n = np.maximum(t.ends - t.starts - length + 1, 0)
            own = np.repeat(np.arange(t.n), n)
            i = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            at = i + t.starts[own]
            h = [Prefix(t.buf, s).of(at, at + length).view(np.int64) for s in (11, 23)]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(own)), batch.column("h").take(pa.array(own)), pa.array(i.astype(np.int32)), pa.array(h[0]), pa.array(h[1])], ["key", "h", "i", "w1", "w2"])

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(uid, place, ranges): repeated windows of each text's stretches, from rows (uid, text)."""
    rows = cut(_stretch_rows(docs, length, gram))
    # equal stretches are one before anything meets by key, so copies make no key hot
    kinds = cut(rows.groupBy("key", "h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "place")).alias("one")))
    many = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    mixed = kinds.join(many, "key").withColumn("hot", F.col("kinds") > hot)
    # texts of the stretches that share a key with others
    wanted = mixed.groupBy(F.col("one.uid").alias("uid")).agg(F.collect_list(F.struct("key", "h", F.col("one.place").alias("place"), "hot")).alias("wanted"))
    parts = cut(mapped(docs.select("uid", "text").join(wanted, "uid").select("text", "wanted"), _cut_out(length), "key long, h long, part binary, hot boolean"))
    # groups of about 4 MB of text, by key
    size = parts.agg(F.sum(F.length("part"))).first()[0] or 0
    groups = max(1, int(size // (4 << 20)) + 1)
    cold = parts.filter("not hot").withColumn("g", F.pmod(F.xxhash64("key"), F.lit(groups)))
    sorted_ = cold.groupBy("g").applyInArrow(_sort_group(length, gram), "key long, h long, ranges array<int>")
    single = parts.filter("hot").select("key", "h", "part").mapInArrow(_window_hashes(length), "key long, h long, i int, w1 long, w2 long")
    twice = single.groupBy("key", "w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "w1", "w2")
    hot_found = single.join(twice, ["key", "w1", "w2"], "left_semi").groupBy("key", "h").agg(F.flatten(F.transform(F.array_sort(F.collect_set("i")), lambda i: F.array(i, i + 1))).alias("ranges"))
    part_found = sorted_.unionByName(hot_found)
    whole = kinds.filter("n > 1").select("key", "h", F.array().cast("array<int>").alias("ranges"))  # empty: all windows
    found = cut(whole.unionByName(part_found.join(whole.select("key", "h"), ["key", "h"], "left_anti")))
    # stretches of which many are equal: few kinds, so their rows stay where they are; NEED bounds the broadcast
    often = found.join(kinds.filter(F.col("n") > OFTEN).select("key", "h"), ["key", "h"], "left_semi")
    often = cut(often)
    if often.limit(NEED + 1).count() > NEED:
        return rows.join(found, ["key", "h"]).select("uid", "place", "ranges")
    rare = found.join(often.select("key", "h"), ["key", "h"], "left_anti")
    marked = rows.join(F.broadcast(often), ["key", "h"], "left")
    loose = rows.join(F.broadcast(often.select("key", "h")), ["key", "h"], "left_anti").join(rare, ["key", "h"])
    return marked.filter("ranges is not null").select("uid", "place", "ranges").unionByName(loose.select("uid", "place", "ranges"))


def _apply(length: int):
    def run(batches):
        for batch in batches:
            n_bytes, n_removed, n_spans, sha = [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                b = np.frombuffer((text or "").encode(), np.uint8)
                edge = np.zeros(len(b) + 1, np.int32)
                for s in spans or ():
                    at, n = s["place"] // (STRETCH * 2), s["place"] % (STRETCH * 2)
                    r = np.asarray(s["ranges"] or [0, n], np.int64)
                    np.add.at(edge, at + r[0::2], 1)
                    np.add.at(edge, at + r[1::2] - 1 + length, -1)
                gone = np.cumsum(edge[:-1]) > 0 if len(b) else np.zeros(0, bool)
                n_bytes.append(len(b))
                n_removed.append(int(gone.sum()))
                n_spans.append(int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum()))
                sha.append(hashlib.sha256(b[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(F.col(id_col).alias("id"), as_text(F.col(text)).alias("text"))
    if named.filter("id is null").isEmpty() and named.groupBy("id").count().filter("count > 1").isEmpty():
        rows = named.withColumn("uid", F.col("id").cast("long")) if docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long") else cut(named.withColumn("uid", F.monotonically_increasing_id()))
    else:  # ids that don't tell rows apart: number the rows, once
        rows = cut(named.withColumn("uid", F.monotonically_increasing_id()))
    spans = repeated_spans(rows.select("uid", "text"), length, gram, hot).groupBy("uid").agg(F.collect_list(F.struct("place", "ranges")).alias("spans"))
    both = rows.join(spans, "uid", "left").select("id", "text", "spans")
    return mapped(both, _apply(length), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)
