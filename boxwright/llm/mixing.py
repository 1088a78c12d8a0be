"""Mixing sources to target weights by Pfair scheduling (operator 2), DataFrame functions only.

Documents of a source form blocks of block_docs. With a target weight w (a share of 1), block i of a source, from 0,
is released at slot floor(i / w) and is due by slot ceil((i + 1) / w); in each slot the released block with the
earliest deadline runs (ties: source order). Weights that sum to 1 leave no deadline unmet, so after any number of
slots each source is within one block of its target share. Weights are taken as given, never rounded to shares.

The schedule is one sequence, but it is planned in stretches of STRETCH slots side by side. A stretch begins WARM
slots early, in a state that every schedule could have there (all blocks that are due, then those due next), and
soon runs as the one schedule does. Stretches that don't begin where their predecessor ended are planned again from
there until all agree, so the result is that of one run from slot 0, in tasks of bounded size.

Every document is placed. Up to the slot in which a source runs dry the mix is on target, as on_target says; the
blocks behind it follow in the order of (i + 1/2) / w, each slot filled. Order by (slot, place) to read the mix.
Numbering the documents of a source takes salted buckets and a prefix sum over their counts, so a hot source is
spread over BUCKETS tasks; a bucket holds rows of one source by a hash of their id.

Defined results: a null source counts as source ''; a source without a weight gets none and is left out (its
decision is the caller's); rows are shuffled within a source by a hash of their id; rows that agree in id keep
any order; a null or repeated id is placed like others; an empty table gives an empty table; columns named
source_name, block, slot, place and on_target are replaced, all other names pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_text, cut, unwrapped, wrapped

STRETCH, WARM = 1000, 256
RESOLUTION = 1000
BUCKETS = 512
BLOCK_DOCS = 8
#: Slots of the plan that are broadcast as arrays (8 bytes each); a longer plan is joined by shuffle.
PLAN_BROADCAST = 1_000_000


def tempered_weights(docs: DataFrame, power: float = 0.7) -> DataFrame:
    """(source_name, weight): counts to a power below 1, so large sources give way to small ones."""
    return docs.groupBy(as_text(F.col("source")).alias("source_name")).count().select("source_name", F.pow("count", F.lit(power)).alias("weight"))


def shares(weights: DataFrame, resolution: int = RESOLUTION) -> DataFrame:
    """(source_name, share): whole shares of resolution by largest remainder, to report a mix; the schedule has no use for it."""
    every = Window.partitionBy()
    w = weights.filter("weight > 0").withColumn("exact", F.col("weight") / F.sum("weight").over(every) * resolution)
    w = w.withColumn("base", F.floor("exact")).withColumn("left", resolution - F.sum("base").over(every))
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc(F.col("exact") - F.col("base")), "source_name"))
    return w.select("source_name", (F.col("base") + F.when(rank <= F.col("left"), 1).otherwise(0)).cast("long").alias("share"))


def _release(done: Column, every: Column) -> Column:
    return F.floor(done * every * (1 + 1e-12)).cast("long")  # near-whole quotients count as whole


def _due(done: Column, every: Column) -> Column:
    return F.ceil((done + 1) * every * (1 - 1e-12)).cast("long")


def _state(done: Column, every: Column, k: Column, n: Column) -> Column:
    """A source between slots: when its next block is released, its deadline and source as one number, blocks done."""
    return F.struct(_release(done, every).alias("free"), (_due(done, every) * n + k).alias("code"), done.alias("done"))


def _begin(t: Column) -> Column:
    """A state at slot t: all blocks due by t have run and, of those released before, the ones due next."""
    n = F.size("s").cast("long")

    def counted(x):
        guess = F.floor(t / x["every"]).cast("long")
        return guess + F.when(_due(guess, x["every"]) <= t, 1).when((guess > 0) & (_due(guess - 1, x["every"]) > t), -1).otherwise(0)

    must = F.transform("s", lambda x, k: F.struct(counted(x).alias("done"), x["every"].alias("every"), k.cast("long").alias("k")))

    def chosen(m):
        more = (t - F.aggregate(m, F.lit(0).cast("long"), lambda a, x: a + x["done"])).cast("int")
        ahead = F.filter(m, lambda x: _release(x["done"], x["every"]) < t)
        codes = F.slice(F.array_sort(F.transform(ahead, lambda x: _due(x["done"], x["every"]) * n + x["k"])), F.lit(1), F.greatest(more, F.lit(0)))
        return F.transform(m, lambda x: _state(x["done"] + F.when(F.array_contains(codes, _due(x["done"], x["every"]) * n + x["k"]), 1).otherwise(0).cast("long"), x["every"], x["k"], n))

    return F.flatten(F.transform(F.array(must), chosen))  # must is used more than once: an array of one holds it


def _run(state: Column, t: Column, slots: Column) -> Column:
    """(state, picks) after so many slots from t on; picks are (source, block) by slot."""
    n = F.size("s").cast("long")
    begun = F.struct(state.alias("state"), F.array().cast("array<struct<k:int,block:bigint>>").alias("picks"))

    def slot(acc, i):
        best = F.array_min(F.transform(acc["state"], lambda x: F.when(x["free"] <= t + i, x["code"])))

        def ran(code):
            k = (code % n).cast("int")
            mine = F.get(acc["state"], k)
            nxt = F.transform(acc["state"], lambda x: F.when(x["code"] == code, _state(x["done"] + 1, F.get("s", k)["every"], k.cast("long"), n)).otherwise(x))
            return F.struct(nxt.alias("state"), F.array_append(acc["picks"], F.struct(k.alias("k"), mine["done"].alias("block"))).alias("picks"))

        return F.transform(F.array(best), ran)[0]

    return F.aggregate(F.sequence(F.lit(0).cast("long"), slots - 1), begun, slot)


def schedule(sources: DataFrame, stretch: int = STRETCH, warm: int = WARM) -> tuple[DataFrame, DataFrame]:
    """(s, last): one row with the array of sources (source_name, weight > 0, blocks) by name; and (k, block, slot).

    Slots go on until the one in which a source would be dry, and that one is left out.
    """
    one = sources.agg(F.array_sort(F.collect_list(F.struct("source_name", "weight", "blocks"))).alias("s")).filter(F.size("s") > 0)
    one = one.withColumn("w", F.aggregate("s", F.lit(0.0), lambda a, x: a + x["weight"]))
    one = one.withColumn("s", F.transform("s", lambda x: F.struct(x["source_name"].alias("source_name"), x["weight"].alias("weight"), x["blocks"].alias("blocks"), (F.col("w") / x["weight"]).alias("every"))))
    # a source is dry at the latest when its block behind the last is due
    one = cut(one.select("s", F.array_min(F.transform("s", lambda x: _due(x["blocks"], x["every"]))).alias("last")))
    parts = one.select("s", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("last") - 1) / stretch).cast("long"))).alias("m"))
    parts = parts.withColumn("t", F.col("m") * stretch).withColumn("from", F.greatest(F.col("t") - warm, F.lit(0).cast("long")))
    tasks = max(1, parts.count() // 4)
    parts = parts.repartition(min(tasks, 10_000), "m")
    ready = parts.withColumn("begin", F.when(F.col("t") == F.col("from"), _begin(F.col("from"))).otherwise(_run(_begin(F.col("from")), F.col("from"), F.col("t") - F.col("from"))["state"]))

    def planned(rows: DataFrame) -> DataFrame:
        ran = rows.select("s", "m", "t", F.explode(F.array("begin")).alias("begin"))  # once, not in each use
        ran = ran.select("m", "t", "begin", F.explode(F.array(_run(F.col("begin"), F.col("t"), F.lit(stretch).cast("long")))).alias("ran"))
        return cut(ran.select("m", "t", F.transform("begin", lambda x: x["done"]).alias("begin"), F.col("ran.state").alias("end"), F.col("ran.picks").alias("picks")))

    plan = planned(ready)
    while True:
        ends = plan.select((F.col("m") + 1).alias("m"), F.col("end").alias("before"))
        off = cut(plan.join(ends, "m").filter(F.col("begin") != F.transform("before", lambda x: x["done"])).select("m", "t", "before"))
        if off.isEmpty():
            break
        again = planned(off.crossJoin(F.broadcast(one.select("s"))).withColumnRenamed("before", "begin"))
        plan = plan.join(off.select("m"), "m", "left_anti").unionByName(again)
    picks = plan.select("t", F.posexplode("picks").alias("i", "p")).select((F.col("t") + F.col("i")).alias("slot"), "p.k", "p.block")
    blocks = one.select(F.posexplode("s").alias("k", "x")).select("k", F.col("x.blocks").alias("_blocks"))
    dry = picks.join(F.broadcast(blocks), "k").filter("block >= _blocks").agg(F.min("slot").alias("h")).first()
    return one, picks.filter(F.col("slot") < (dry["h"] if dry and dry["h"] is not None else 0))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, block_docs: int = BLOCK_DOCS, resolution: int = STRETCH, id_col: str = "doc_id", broadcast: int = PLAN_BROADCAST) -> DataFrame:
    """docs with source_name, block, slot, place (in the block) and on_target; resolution: slots of a stretch."""
    rows = wrapped(docs, source_name=as_text(F.col("source")), hash=F.xxhash64(F.col(id_col)), id=F.col(id_col))
    rows = rows.withColumn("bucket", F.pmod("hash", F.lit(BUCKETS)))
    counts = docs.groupBy(as_text(F.col("source")).alias("source_name"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(BUCKETS)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts)
    sizes = counts.groupBy("source_name").agg(F.sum("n").alias("total"))
    if weights is None:
        weights = sizes.select("source_name", F.pow("total", F.lit(0.7)).alias("weight"))
    given = weights.filter("weight > 0").select("source_name", F.col("weight").cast("double").alias("weight"))
    given = given.join(sizes, "source_name", "left").select("source_name", "weight", F.ceil(F.coalesce("total", F.lit(0)) / block_docs).cast("long").alias("blocks"))
    one, picks = schedule(given, resolution)
    picks = cut(picks)
    horizon = picks.count()
    every = one.select(F.posexplode("s").alias("k", "x")).select("k", F.col("x.source_name").alias("source_name"), F.col("x.every").alias("every"), F.col("x.blocks").alias("blocks"))
    done = picks.groupBy("k").agg(F.count(F.lit(1)).alias("done"))
    each = cut(every.join(done, "k", "left").fillna(0, ["done"]))
    before = Window.partitionBy("source_name").orderBy("bucket")
    starts = counts.join(F.broadcast(each), "source_name").select("source_name", "bucket", "k", "every", (F.sum("n").over(before) - F.col("n")).alias("start"))
    inner = Window.partitionBy("source_name", "bucket").orderBy("hash", "id")
    numbered = rows.withColumn("i", F.row_number().over(inner)).join(starts, ["source_name", "bucket"])
    numbered = numbered.withColumn("rank", F.col("start") + F.col("i") - 1).withColumn("block", F.floor(F.col("rank") / block_docs)).withColumn("place", F.col("rank") % block_docs)
    if horizon <= broadcast:
        slots = picks.groupBy("k").agg(F.array_sort(F.collect_list("slot")).alias("slots"))
        placed = numbered.join(F.broadcast(slots), "k", "left").withColumn("planned", F.get("slots", F.col("block").cast("int"))).drop("slots")
    else:
        placed = numbered.join(picks.withColumnRenamed("slot", "planned"), ["k", "block"], "left")
    # behind the horizon: how many blocks of all sources that are left come before, by (block + 1/2) * every, source
    rest = each.agg(F.array_sort(F.collect_list(F.struct("k", "every", "blocks", "done"))).alias("rest"))
    at = (F.col("block") + 0.5) * F.col("every")

    def earlier(x):
        guess = F.floor(at / x["every"] - 0.5).cast("long")
        comes = lambda b: F.when(((b + 0.5) * x["every"] < at) | (((b + 0.5) * x["every"] == at) & (x["k"] < F.col("k"))), 1).otherwise(0)
        n = guess - 1 + comes(guess - 1) + comes(guess) + comes(guess + 1)
        n = F.when(x["k"] == F.col("k"), F.col("block")).otherwise(n)
        return F.greatest(F.least(n, x["blocks"]) - x["done"], F.lit(0))

    later = horizon + F.aggregate(F.transform("rest", earlier), F.lit(0).cast("long"), lambda a, x: a + x)
    placed = placed.crossJoin(F.broadcast(rest)).withColumn("slot", F.coalesce("planned", later))
    return unwrapped(placed, docs.columns, source_name=F.col("source_name"), block=F.col("block"), slot=F.col("slot"), place=F.col("place"), on_target=F.col("slot") < horizon)


def mixed_order(docs: DataFrame, with_slot: bool = False, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs in mixed order: files hold ascending ranges of slots, each sorted; with their slot, if wanted.

    Ranges are cut by slot number, so no sampling pass is needed.
    """
    placed = mix_sources(wrapped(docs, source=F.col("source"), **{id_col: F.col(id_col)}), id_col=id_col, **options)
    block = options.get("block_docs", BLOCK_DOCS)
    # at most so many slots: as many blocks as there are, each source's last one perhaps not full
    sizes = docs.groupBy(as_text(F.col("source"))).count().agg(F.sum(F.ceil(F.col("count") / block))).first()[0] or 1
    files = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.least(F.floor(F.col("slot") * files / F.lit(int(sizes))), F.lit(files - 1)).cast("int")
    sorted_ = placed.repartitionById(files, part).sortWithinPartitions("slot", "place")
    return unwrapped(sorted_, docs.columns, **({"slot": F.col("slot")} if with_slot else {}))
