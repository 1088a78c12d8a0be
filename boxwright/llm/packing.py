"""Best-fit packing of token pieces into sequences (operator 8).

A sequence has three capacities: tokens, documents and attention cost (the sum of squared lengths). Pieces come
longest first; of the open sequences that can take a piece under every capacity, the one with the smallest
weighted norm of what would be left (each capacity as a fraction) gets it, else a new one opens. Weights favour
tokens, so few sequences result.

Pieces are dealt by hash into pools of about POOL pieces that are packed apart, each in one task: work grows in
proportion to the input, and a pool leaves about one sequence partly filled. The sequences that are filled less
than REPACK of the tokens are then opened again and their pieces packed in pools of their own.

With a column slot of whole numbers, as the mix gives it, pools are consecutive ranges of slots and sequence_id
follows them; a column of this name and another type is ignored, like all other columns.

Defined results: a null or empty text is one piece that holds the end id; ties in length go by id, then piece;
rows that repeat, also with null ids, are packed each and spread over the pools; very long texts are cut into pieces;
an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .tokens import token_pieces

POOL = 6000
REPACK = 0.97
WEIGHTS = (1.0, 0.01, 0.01)


def best_fit(lengths: np.ndarray, tokens: int, documents: int, cost: float, weights=WEIGHTS) -> np.ndarray:
    """Bin number of each piece; lengths come in descending order."""
    n = len(lengths)
    cap = np.array([tokens, documents, cost], float)
    w = np.asarray(weights, float)
    where = np.empty(n, np.int64)
    full = int(np.searchsorted(-lengths, -tokens, side="right"))  # as long as a sequence: alone
    where[:full] = np.arange(full)
    left = np.empty((3, max(n - full, 1)))
    name = np.empty(max(n - full, 1), np.int64)
    bins, m = full, 0
    least = float(lengths[-1]) / tokens if n else 0.0
    for i in range(full, n):
        item = np.array([lengths[i], 1.0, float(lengths[i]) ** 2]) / cap
        if i % 64 == 0 and m:  # sequences that no later piece fits into are closed
            live = np.flatnonzero((left[0, :m] >= least - 1e-12) & (left[1, :m] * documents >= 0.5))
            if len(live) < m:
                left[:, : len(live)], name[: len(live)] = left[:, live], name[live]
                m = len(live)
        rest = left[:, :m] - item[:, None]
        fits = rest.min(axis=0) >= -1e-9 if m else np.zeros(0, bool)
        if fits.any():
            score = np.where(fits, w @ (rest * rest), np.inf)
            k = int(score.argmin())
            left[:, k] = rest[:, k]
        else:
            k, m = m, m + 1
            left[:, k] = 1.0 - item
            name[k] = bins
            bins += 1
        where[i] = name[k]
    return where


def _pack_pool(tokens: int, documents: int, cost: float, id_col: str):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", id_col, "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bin_ = best_fit(pdf["length"].to_numpy(np.int64), tokens, documents, cost)
        pdf["sequence_id"] = (int(key[0]) << 32) + bin_
        by = pdf.groupby("sequence_id", sort=False)["length"]
        pdf["offset"] = by.cumsum() - pdf["length"]
        pdf["filled"] = by.transform("sum")
        return pdf

    return run


def _pools(pieces: DataFrame, n: int, pool: int, first: int, id_col: str, slots: int | None = None, among: int = 0) -> DataFrame:
    count = max(1, -(-n // pool))
    if slots is not None:
        # consecutive slots; the second round's pools get the odd numbers beside the first round's of the same slots
        k = F.floor(F.col("slot") * count / slots).cast("long")
        return pieces.withColumn("pool", F.floor(k * among / count).cast("long") * 2 + 1 if among else k * 2)
    # pieces come from a written table, so their numbers stay; ids that repeat don't meet in one pool
    return pieces.withColumn("pool", F.pmod(F.xxhash64(id_col, "piece", F.lit(first), F.monotonically_increasing_id()), F.lit(count)) + F.lit(first))


def pack(pieces: DataFrame, tokens: int = 2048, documents: int = 2048, cost: float | None = None, pool: int = POOL, id_col: str = "doc_id") -> DataFrame:
    """pieces (id, piece, start, length, ids_crc32) with sequence_id and offset."""
    cost = float(cost or tokens**2)
    cols = [c for c in (id_col, "piece", "start", "length", "ids_crc32") if c in pieces.columns]
    inner = [*cols, "slot"] if "slot" in pieces.columns else cols
    kept = cut(pieces.select(*inner))
    slots = (kept.agg(F.max("slot")).first()[0] or 0) + 1 if "slot" in inner else None
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    schema = f"{fields}, pool long, sequence_id long, offset long, filled long"
    n = kept.count()
    once = cut(_pools(kept, n, pool, 0, id_col, slots).groupBy("pool").applyInPandas(_pack_pool(tokens, documents, cost, id_col), schema))
    good = F.col("filled") >= REPACK * tokens
    rest = once.filter(~good).select(*inner)
    first = max(1, -(-n // pool))
    again = _pools(rest, rest.count(), pool, first, id_col, slots, first).groupBy("pool").applyInPandas(_pack_pool(tokens, documents, cost, id_col), schema)
    return once.filter(good).unionByName(again).select(*cols, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, tokens: int = 2048, **options) -> DataFrame:
    if "slot" not in docs.columns or docs.schema["slot"].dataType.typeName() not in ("integer", "long"):
        return pack(token_pieces(docs, path, tokens), tokens, **options)
    # the slot travels with the id, so that ids that repeat keep their own
    both = docs.select(F.struct("doc_id", "slot").alias("_id"), "text")
    pieces = token_pieces(both, path, tokens, id_col="_id")
    return pack(pieces.select("_id.*", "piece", "start", "length", "ids_crc32"), tokens, **options)
