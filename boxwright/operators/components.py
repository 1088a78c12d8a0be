"""Connected components of a link table, by hooking and pointer doubling on DataFrames.

Links never reach the driver; each round is cut by a checkpoint, and only row counts come back. A round hooks
every node to its smallest smaller neighbour, doubles pointers until they are flat, and contracts the links, so
long chains take a logarithmic number of rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (u, v) that isn't the smallest of its component."""
    edges = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())
    roots = None
    while edges.count():
        parent = cut(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")))
        while True:
            up = parent.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            jumped = parent.join(up, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
            # a second jump, over the first one's pointers, says whether any is left
            far = parent.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            jumped = jumped.join(far, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved"))
            jumped = cut(jumped)
            moved = jumped.filter("moved").count()
            parent = jumped.select("node", "root")
            if not moved:
                break
        up = parent.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        if roots is None:
            roots = parent
        else:
            roots = cut(roots.join(up, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")).unionByName(parent))
        for end in ("u", "v"):
            edges = edges.join(up, F.col(end) == F.col("_n"), "left").withColumn(end, F.coalesce("_r", end)).drop("_n", "_r")
        edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())
    if roots is None:
        kind = links.schema["u"].dataType.simpleString()
        return links.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
    return roots
