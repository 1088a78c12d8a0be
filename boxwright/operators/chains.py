"""List ranking: the head of each node's chain of successor links, and how far behind it the node stands.

Pointers to ancestors double each round, with the number of links that they skip, so a chain of n nodes takes log2 n
rounds of joins and no chain meets in one task. Nodes that have found their head take no part any more, and the
others point to different nodes, so no key of a round's join is hot. Each round is a written table.

Links that form a loop have no head; they are cut at its least node, which then is the head.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut


def ranked(links: DataFrame) -> DataFrame:
    """(node, head, place, loop) of all nodes of links (u, v), v being u's successor; a node has one of each at most.

    place counts from 0 at the head. Links from a node to itself don't count; an empty table gives an empty table.
    """
    links = cut(links.select("u", "v").filter("u <> v").distinct())
    inner = links.select(F.col("v").alias("node"), F.col("u").alias("to"), F.lit(1).cast("long").alias("steps"), F.least("u", "v").alias("least"), F.lit(False).alias("done"))
    heads = links.join(links.select(F.col("v").alias("_v")), F.col("u") == F.col("_v"), "left_anti").select(F.col("u").alias("node"), F.col("u").alias("to"), F.lit(0).cast("long").alias("steps"), F.col("u").alias("least"), F.lit(True).alias("done"))
    state = cut(inner.unionByName(heads))
    left, before, span = state.filter("not done").count(), -1, 1
    while left and not (left == before and span >= left):
        up = state.select(F.col("node").alias("_n"), F.col("to").alias("_to"), F.col("steps").alias("_steps"), F.col("least").alias("_least"), F.col("done").alias("_done"))
        moved = state.filter("not done").join(up, F.col("to") == F.col("_n")).select("node", F.col("_to").alias("to"), (F.col("steps") + F.col("_steps")).alias("steps"), F.least("least", "_least").alias("least"), F.col("_done").alias("done"))
        state = cut(state.filter("done").unionByName(moved))
        before, left, span = left, state.filter("not done").count(), span * 2
    found = state.filter("done").select("node", F.col("to").alias("head"), F.col("steps").alias("place"), F.lit(False).alias("loop"))
    if not left:
        return found
    # what is left are loops, and least has come round each of them
    rings = state.filter("not done").select(F.col("node").alias("_n"), "least")
    opened = ranked(links.join(rings, F.col("v") == F.col("_n")).filter("v <> least").select("u", "v"))
    return found.unionByName(opened.withColumn("loop", F.lit(True)))
