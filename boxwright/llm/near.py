"""Near-duplicates by SetSketch registers (operator 3).

A document's set holds its distinct five-word shingles. Its sketch has REGISTERS registers: the minimum over the
set of one exponential hash value each, rounded to a power of BASE and truncated to a byte. Registers of a union
are the maxima of the registers, so sketches are mergeable, and equal registers are the likelier the more two
sets overlap. BANDS bands of registers give candidate pairs; their Jaccard similarity is estimated jointly, by the
likelihood of how many registers are larger, smaller and equal given both sets' sizes; pairs that cannot reach the
threshold at ODDS are dropped, and the others are verified on full sets.

With 32 bands of 4 registers a pair at the threshold 0.75 is missed with probability 5e-6 at most (registers are
equal a little more often than minima).

Documents with equal sets are one node from the start. All pairs of a band's bucket are never emitted: members
are first compared with one pivot of the bucket, in a few rounds with other pivots for buckets whose members are
not yet one component. A component that still holds much of a bucket is then compared with all outsiders of such
buckets at once, in blocks of full sets, whatever number of buckets they share; a task returns one link for each
outside component at most. Pairs across the other components that still share a bucket are compared exhaustively.
Links inside a component cannot change it, so no component is lost. Links and components stay distributed.

Defined results: without words (null, empty, blanks only) n_shingles is 0 and a row is a component of its own;
rows that agree in id hold one text, and are one node; a null id belongs to the component of its text and is kept only if no row with
an id has that component; an empty table gives an empty table; other columns are ignored (near_dedup keeps them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, cut, mapped, text_chunks
from .components import components
from .rolling import Prefix, U, lower_ascii, mix, runs_within, splitmix, words

REGISTERS, BANDS, ROWS = 128, 32, 4
BASE, RATE = 1.1, 20.0
ODDS = 10.0
WIDTH = 5
PIVOT_ROUNDS = 1
#: Larger buckets are compared in blocks of BLOCK members, and only pairs that may be links leave the task.
SMALL, BLOCK = 8, 400
#: A component leads a bucket if LEAD members and one in LEADERS are its own: a bucket has LEADERS leaders at most.
LEAD, LEADERS = 24, 8
#: A block of full sets: so many sets, and about so many shingles in all.
BLOCK_SETS, BLOCK_SHINGLES = 1000, 500_000
SALTS = 64
#: At most so many ids are broadcast to pick full sets before they are shuffled.
NEED = 500_000

_A = splitmix(101, REGISTERS) | U(1)
_B = splitmix(202, REGISTERS)
_Q = splitmix(303, 8) | U(1)


def shingle_hashes(t, width: int = WIDTH) -> list[np.ndarray]:
    """The distinct shingles of each text, as sorted 64-bit hashes."""
    buf = lower_ascii(t.buf)
    s, e, doc = words(buf, t.starts, t.ends)
    w = Prefix(buf).of(s, e)
    at = runs_within(doc, width)
    h = np.zeros(len(at), U)
    for k in range(width):
        h += w[at + k] * _Q[k]
    h, owner = mix(h), doc[at]
    n_words = np.bincount(doc, minlength=t.n)
    ends = np.cumsum(n_words)
    bounds = np.searchsorted(owner, np.arange(t.n + 1))
    out = []
    for i in range(t.n):
        n = n_words[i]
        if n >= width:
            out.append(np.unique(h[bounds[i] : bounds[i + 1]]))
        elif n:
            mine = w[ends[i] - n : ends[i]]
            out.append(mix((mine * _Q[:n]).sum(keepdims=True) + np.array([n], U) * _Q[7:]))
        else:
            out.append(np.zeros(0, U))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """The truncated, exponentially spaced minima of a set."""
    if not len(shingles):
        return np.zeros(REGISTERS, np.uint8)
    least = np.full(REGISTERS, ~U(0), U)
    for i in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[i : i + 2048, None] * _A + _B).min(axis=0), out=least)
    x = -np.log1p(-np.minimum((least.astype(np.float64) + 0.5) / 2.0**64, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, 255).astype(np.uint8)


def sketches(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n (set size), fp1 and fp2 (of the set), sketch, for each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch, t in text_chunks(batches):
            sets = shingle_hashes(t)
            fp1 = np.array([x.sum(dtype=U) for x in sets], U).view(np.int64)
            fp2 = np.array([mix(x + U(7)).sum(dtype=U) for x in sets], U).view(np.int64)
            cols = [batch.column(0), pa.array(np.array([len(x) for x in sets], np.int64)), pa.array(fp1), pa.array(fp2), pa.array([registers(x).tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n", "fp1", "fp2", "sketch"])

    rows = docs.select(F.col(id_col).alias("id"), as_text(F.col(text)).alias("text"))
    return mapped(rows, run, f"id {kind}, n long, fp1 long, fp2 long, sketch binary")


def full_sets(docs: DataFrame) -> DataFrame:
    """node and its whole set, from rows (node, text)."""
    kind = docs.schema["node"].dataType.simpleString()

    def run(batches):
        for batch, t in text_chunks(batches):
            sets = shingle_hashes(t)
            sizes = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))], ["node", "shingles"])

    return mapped(docs, run, f"node {kind}, shingles array<long>")


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def may_reach(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each pair's likelihood leaves the threshold possible (registers as rows, exact set sizes)."""
    up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
    u = na / (na + nb)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 101)[None, :] * top[:, None]
    pu, pv = _p(u[:, None] - v[:, None] * grid), _p(v[:, None] - u[:, None] * grid)
    tiny = 1e-12
    ll = up[:, None] * np.log(np.maximum(pu, tiny)) + down[:, None] * np.log(np.maximum(pv, tiny)) + (a.shape[1] - up - down)[:, None] * np.log(np.maximum(1 - pu - pv, tiny))
    best = np.where(grid >= threshold - 0.01, ll, -np.inf).max(axis=1)
    return best >= ll.max(axis=1) - ODDS


def _estimated(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) that may reach the threshold."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").filter(F.least("nu", "nv") >= threshold * F.greatest("nu", "nv"))
    kind = pairs.schema["u"].dataType.simpleString()

    def run(batches):
        for b in batches:
            regs = [np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("su", "sv")]
            n = [b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("nu", "nv")]
            if len(n[0]):
                ok = pa.array(may_reach(regs[0], regs[1], n[0], n[1], threshold))
                yield pa.RecordBatch.from_arrays([b.column("u").filter(ok), b.column("v").filter(ok)], ["u", "v"])

    return both.select("u", "v", "nu", "nv", "su", "sv").mapInArrow(run, f"u {kind}, v {kind}")


def _only(sets: DataFrame, need: DataFrame) -> DataFrame:
    """The sets of the nodes in need (a written table): picked before any shuffle where need has few rows.

    NEED bounds what is broadcast; beyond it the join that follows picks them, with the same result.
    """
    return sets.join(F.broadcast(need), "node", "left_semi") if need.limit(NEED + 1).count() <= NEED else sets


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a written table) whose full sets have 100 * intersection >= percent * union."""
    sides = [_only(sets, pairs.select(F.col(x).alias("node"))) for x in ("u", "v")]
    a, b = sides[0].select(F.col("node").alias("u"), F.col("shingles").alias("a")), sides[1].select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    both = pairs.join(a, "u").join(b, "v").withColumn("common", F.size(F.array_intersect("a", "b")))
    return both.filter(F.expr(f"100L * common >= {percent}L * (size(a) + size(b) - common)")).select("u", "v")


def _block_pairs(entries: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different components in large buckets (key, node, comp, _size) that may reach the threshold.

    Members fall into blocks by hash; each pair of blocks is one group, so no task holds more than two blocks.
    """
    kind = nodes.schema["node"].dataType.simpleString()
    blocks = F.ceil(F.col("_size") / BLOCK)
    rows = entries.join(nodes.select("node", "n", "sketch"), "node").withColumn("_b", F.pmod(F.xxhash64("node"), blocks))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).select("key", F.least("_b", "_o").alias("lo"), F.greatest("_b", "_o").alias("hi"), "_b", "node", "comp", "n", "sketch")

    def run(key, t):
        node, comp, n, b = (t.column(c).to_numpy() for c in ("node", "comp", "n", "_b"))
        out_u, out_v = [], []
        if len(node) > 1 and comp.min() != comp.max():
            regs = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, REGISTERS)
            for i in range(len(node)):
                j = np.flatnonzero((comp != comp[i]) & (node < node[i]) & (np.minimum(n, n[i]) >= threshold * np.maximum(n, n[i])) & ((b != b[i]) | (key[1].as_py() == key[2].as_py())))
                if len(j):
                    j = j[may_reach(np.broadcast_to(regs[i], (len(j), REGISTERS)), regs[j], np.full(len(j), float(n[i])), n[j].astype(float), threshold)]
                    out_u.append(np.full(len(j), node[i]))
                    out_v.append(node[j])
        u = np.concatenate(out_u) if out_u else node[:0]
        v = np.concatenate(out_v) if out_v else node[:0]
        return pa.table({"u": u, "v": v})

    return rows.groupBy("key", "lo", "hi").applyInArrow(run, f"u {kind}, v {kind}")


def common_sizes(a: list[np.ndarray], b: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """Intersection sizes of every set of a with every set of b, by products of membership matrices."""
    out = np.zeros((len(a), len(b)), np.float32)
    flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b)]
    both = np.intersect1d(*flat)
    cells = []
    for sets, values in zip((a, b), flat, strict=True):
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        hit = np.isin(values, both)
        at = np.searchsorted(both, values[hit])
        order = np.argsort(at, kind="stable")
        cells.append((owner[hit][order], at[order]))
    for lo in range(0, len(both), step):
        part = []
        for sets, (owner, at) in zip((a, b), cells, strict=True):
            i, j = np.searchsorted(at, [lo, lo + step])
            m = np.zeros((len(sets), min(step, len(both) - lo)), np.float32)
            m[owner[i:j], at[i:j] - lo] = 1
            part.append(m)
        out += part[0] @ part[1].T
    return out


def _leaders(open_entries: DataFrame) -> DataFrame:
    """(key, leader) of entries (key, node, comp, _size): components that hold much of a bucket."""
    held = open_entries.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"), F.max("_size").alias("_size"))
    return held.filter(f"m >= {LEAD} and m * {LEADERS} >= _size").select("key", F.col("comp").alias("leader"))


def _leader_links(open_entries: DataFrame, leaders: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of leaders with outsiders of their buckets, on full sets: enough to join their components.

    Of two leaders of a bucket the smaller one has the other as its outsider. Both sides fall into blocks by hash,
    and each pair of an inner and an outer block is one group.
    """
    kind = nodes.schema["node"].dataType.simpleString()
    also = leaders.select("key", F.col("leader").alias("comp"), F.lit(True).alias("leads"))
    rows = open_entries.join(also, ["key", "comp"], "left").join(leaders, "key")
    rows = rows.filter("comp = leader or leads is null or comp > leader").select("leader", "node", "comp").distinct()
    rows = rows.join(nodes.select("node", "n"), "node").withColumn("inner", F.col("comp") == F.col("leader"))
    blocks = lambda side: F.greatest(F.ceil(F.sum(side.cast("long")) / BLOCK_SETS), F.ceil(F.sum(F.when(side, F.col("n")).otherwise(0)) / BLOCK_SHINGLES))
    sizes = rows.groupBy("leader").agg(blocks(F.col("inner")).alias("_in"), blocks(~F.col("inner")).alias("_out")).filter("_in > 0 and _out > 0")
    rows = rows.join(sizes, "leader")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("inner"), F.col("_in")).otherwise(F.col("_out")))
    rows = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("inner"), F.col("_out")).otherwise(F.col("_in")) - 1)))
    rows = rows.select("leader", F.when(F.col("inner"), F.col("_own")).otherwise(F.col("_other")).alias("bi"), F.when(F.col("inner"), F.col("_other")).otherwise(F.col("_own")).alias("bo"), "node", "comp", "inner")

    def run(t):
        inside = t.column("inner").to_numpy()
        a, b = t.filter(pa.array(inside)), t.filter(pa.array(~inside))
        shingles = [[x.values.to_numpy() for x in side.column("shingles").combine_chunks()] if len(side) else [] for side in (a, b)]
        common = common_sizes(*shingles)
        na, nb = (np.array([len(x) for x in side], np.float32) for side in shingles)
        linked = 100 * common >= percent * (na[:, None] + nb[None, :] - common)
        out = np.flatnonzero(linked.any(axis=0))
        comps = b.column("comp").take(pa.array(out)).to_numpy()
        out = out[np.unique(comps, return_index=True)[1]]
        return pa.table({"u": b.column("node").take(pa.array(out)), "v": a.column("node").take(pa.array(linked[:, out].argmax(axis=0)))})

    rows = cut(rows)
    return rows.join(_only(sets, rows.select("node")), "node").groupBy("leader", "bi", "bo").applyInArrow(run, f"u {kind}, v {kind}")


def near_groups(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept for each row of docs."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = cut(sketches(docs, id_col, text))
    # a set that many rows have is aggregated in parts by a hash of their id, and its node goes back to the parts
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    parts = cut(salted.filter("n > 0").groupBy("n", "fp1", "fp2", "salt").agg(F.min("id").alias("low"), F.min("sketch").alias("sketch")))
    classes = parts.groupBy("n", "fp1", "fp2").agg(F.min("low").alias("node"), F.min("sketch").alias("sketch"))
    nodes = cut(classes.filter("node is not null"))
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("sketch", i * ROWS + 1, F.lit(ROWS))))
    bands = nodes.select("node", F.explode(keys).alias("key"))
    shared = bands.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("size")).filter("low < high")
    sized = cut(bands.join(shared.select("key", "size"), "key"))
    entries = cut(sized.join(sized.groupBy("node").agg(F.sum("size").alias("degree")), "node").select("node", "key", "degree"))
    members = entries.select("node").distinct()
    texts = docs.select(F.col(id_col).alias("node"), as_text(F.col(text)).alias("text")).join(members, "node", "left_semi")
    # a repeated id comes with its text more than once: one set of each node is enough
    sets = cut(full_sets(texts.dropDuplicates(["node"]) if _repeats(rows) else texts))
    links = spark.createDataFrame([], f"u {kind}, v {kind}")
    tested, roots = links, None

    def labelled(entries: DataFrame) -> DataFrame:
        if roots is None:
            return entries.withColumn("comp", F.col("node"))  # with degree
        r = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        return entries.join(r, F.col("node") == F.col("_n"), "left").select("node", "key", "degree", F.coalesce("_r", "node").alias("comp"))

    for turn in range(PIVOT_ROUNDS + 3):
        now = labelled(entries)
        if turn == 0:  # the hub of the bucket: who shares the most buckets with others
            choice = F.struct("degree", F.xxhash64("node"), F.col("node"))
        else:  # another one in every bucket
            choice = F.struct(F.xxhash64("node", "key", F.lit(turn)), F.col("node"))
        open_ = now.groupBy("key").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high"), F.count(F.lit(1)).alias("_size"), F.max_by(F.struct("node", "comp"), choice).alias("pivot")).filter("_low < _high")
        if turn == PIVOT_ROUNDS + 1:  # leading components against all outsiders
            left = cut(now.join(open_.select("key", "_size"), "key"))
            leaders = cut(_leaders(left))
            if leaders.isEmpty():
                continue
            found = cut(_leader_links(left, leaders, nodes, sets, percent))
            # what a leader holds of its bucket is compared with all others there
            entries = cut(left.join(leaders.withColumnRenamed("leader", "comp"), ["key", "comp"], "left_anti").select("node", "key", "degree"))
            if not found.isEmpty():
                links = links.unionByName(found)
                roots = components(links)
            continue
        if turn <= PIVOT_ROUNDS:
            pairs = now.join(open_.select("key", "pivot"), "key").filter("comp <> pivot.comp").select(F.greatest("node", "pivot.node").alias("u"), F.least("node", "pivot.node").alias("v"))
        else:  # whatever two components still share a bucket
            left = now.join(open_.select("key", "_size"), "key")
            few = left.filter(F.col("_size") <= SMALL)
            right = few.select("key", F.col("node").alias("v"), F.col("comp").alias("vc"))
            pairs = few.join(right, "key").filter("comp <> vc and node > v").select(F.col("node").alias("u"), "v")
            blocks = _block_pairs(left.filter(F.col("_size") > SMALL), nodes, percent / 100)
        pairs = cut(pairs.distinct().join(tested, ["u", "v"], "left_anti"))
        close = _estimated(pairs, nodes, percent / 100)
        if turn > PIVOT_ROUNDS:  # blocks have estimated theirs
            close = close.unionByName(blocks.distinct().join(tested, ["u", "v"], "left_anti"))
        close = cut(close)
        tested = tested.unionByName(pairs)
        n = close.count()
        if n:
            found = cut(_verified(close, sets, percent))
            links = links.unionByName(found)
            if found.count():
                roots = components(links)
        elif turn < PIVOT_ROUNDS and open_.isEmpty():
            break
    of_class = nodes.select("n", "fp1", "fp2", "node")
    if roots is not None:
        of_class = of_class.join(roots, "node", "left").select("n", "fp1", "fp2", F.coalesce("root", "node").alias("node"))
    of_part = parts.select("n", "fp1", "fp2", "salt").join(of_class, ["n", "fp1", "fp2"])
    out = salted.join(of_part, ["n", "fp1", "fp2", "salt"], "left")
    comp = F.coalesce("node", "id")
    kept = F.coalesce(F.col("id") == comp, comp.isNull())
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), kept.alias("kept"))


def _repeats(rows: DataFrame) -> bool:
    """Does an id come more than once?"""
    return not rows.groupBy("id").count().filter("id is not null and count > 1").isEmpty()


def near_dedup(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay: one document of each component (all rows of docs that have its id)."""
    gone = near_groups(docs, percent, id_col, text).filter(~F.col("kept") & F.col(id_col).isNotNull()).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
