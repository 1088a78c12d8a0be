"""Bridge closure: what anchors reach over matching pairs, as a loop of joins until nothing is added."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut


def reach(anchors: DataFrame, pairs: DataFrame, both_ways: bool = True) -> DataFrame:
    """ids reachable from anchors (id) over pairs (a, b), from a to b or both ways; each round is a written table."""
    pairs = pairs.select("a", "b")
    steps = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct() if both_ways else pairs.distinct()
    seen = front = anchors.select("id").distinct()
    while True:
        found = steps.join(front, steps["a"] == front["id"], "left_semi").select(F.col("b").alias("id")).distinct()
        front = cut(found.join(seen, "id", "left_anti"))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))
