"""Counts and times of a run's stages, taken while they are written: no second scan."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .shared import cut


class Stages:
    """The stages of a run, one after the other; each is written, and its counts come from the rows that pass."""

    def __init__(self, spark: SparkSession, counts: dict[str, tuple[str | None, Column]]):
        self.spark, self.counts, self.found, self.seconds = spark, counts, {}, {}

    def run(self, name: str, df: DataFrame) -> DataFrame:
        """df as a written table. A count whose column df lacks is null."""
        seen = Observation(f"stage {name}")
        began = time.monotonic()
        out = cut(df.observe(seen, *[c.alias(k) for k, (need, c) in self.counts.items() if need is None or need in df.columns]))
        self.seconds[name] = round(time.monotonic() - began, 3)
        self.found[name] = seen.get
        return out

    def report(self) -> DataFrame:
        """A row for each stage: its counts and seconds."""
        rows = [(i, n, *[self.found[n].get(k) for k in self.counts], self.seconds[n]) for i, n in enumerate(self.found)]
        return self.spark.createDataFrame(rows, f"step int, stage string, {', '.join(f'{k} long' for k in self.counts)}, seconds double")


def tier_counts() -> dict[str, tuple[str | None, Column]]:
    """Rows, and rows of each tier, with the column that a count needs."""
    return {"rows": (None, F.count(F.lit(1))), **{t: ("tier", F.count_if(F.col("tier") == t)) for t in ("auto", "review", "low_conf")}}
