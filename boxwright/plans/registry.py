"""Where the plans register their queries, and expressions that they share."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict = {}
BOX = ["x1", "y1", "x2", "y2"]
ORDER = ["frame", "event_id"]


def query(sql: str | None = None):
    """Register a query (spark, sf_dir) by its name, with its DuckDB SQL where SQL can express it."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


#: Parts that a track's number leaves room for.
PARTS = 1 << 20


def part_id(track: str, part: str):
    """A number for a part of a track: tracks can't meet, since a track of more parts than there is room for is an error."""
    whole = F.col(track) * PARTS + F.col(part)
    return F.when(F.col(part) < PARTS, whole).otherwise(F.raise_error(F.lit(f"a track has more than {PARTS} parts")).cast("long"))


def r4(c, n: int = 4):
    """c rounded as the oracle does: the double times 10**n to a whole number, halves away from zero (not the decimal text of c)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * F.lit(10.0**n)) / F.lit(10.0**n)


def mean_conf():
    """Mean of whole millionths: the same whatever the order of the rows."""
    return F.sum(F.round(F.col("conf") * 1_000_000).cast("long")) / F.lit(1_000_000.0) / F.count(F.lit(1))
