"""Quality classifier (operator 7): random-indexing vectors, pooled, and a two-layer network.

Every term has a sparse random index vector (NONZERO entries of +-1 among DIM, from its hash). Terms are the words
and their shapes (letters, capitals, digits and marks, runs collapsed). A term's vector is the sum of the index
vectors of the terms of its kind within NEAR places of it in the training texts (random indexing), brought to length
1, with its own index vector added; a term that isn't among the TERMS commonest of its kind there has the latter
alone. A document pools the vectors of its words and those of its shapes, by mean, with the norms of the mean index
vectors (large if words repeat) and the logarithm of its length. A network with one hidden layer, in numpy, gives the
logit of label 1; a temperature fitted on a held-back part of the training rows calibrates it.

Training takes at most TRAIN_ROWS labelled rows whose crc32(doc_id) mod 3 is not 1 (smallest hash of the id first).
TERMS bounds the model, not what is scored.

Defined results: empty and null texts have a zero vector and get the score of that; without labels of both kinds
every score is 0.5; rows that repeat are scored each; a null id counts as not held out and never trains; other columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, as_text, crc32_text, cut, mapped, text_chunks
from .rolling import Prefix, U, lower_ascii, mix, words

TRAIN_ROWS = 6000
DIM, NONZERO, HIDDEN = 128, 4, 32
TERMS, NEAR = 4000, 2

_KIND = np.arange(256, dtype=np.uint8)
_KIND[97:123] = ord("a")
_KIND[65:91] = ord("A")
_KIND[48:58] = ord("9")
_KIND[128:] = ord("a")


def held_out(id_col: str = "doc_id"):
    return crc32_text(F.col(id_col)) % 3 == 1


def terms(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, hash of its shape, and its text's number."""
    low = lower_ascii(t.buf)
    s, e, doc = words(low, t.starts, t.ends)
    w = Prefix(low).of(s, e)
    kind = _KIND[t.buf]
    change = np.ones(len(kind), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[s] = True
    kept = np.zeros(len(kind) + 1, np.int64)
    np.cumsum(change, out=kept[1:])
    shape = Prefix(kind[change]).of(kept[s], kept[e])
    return w, shape, doc


def index_pairs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the index vector of each hash: two arrays of NONZERO columns."""
    x = mix(h + U(99))
    cols = np.stack([(x >> U(16 * k)) & U(DIM - 1) for k in range(NONZERO)], axis=1).astype(np.int64)
    signs = np.stack([(x >> U(16 * k + 12)) & U(1) for k in range(NONZERO)], axis=1).astype(np.float32) * 2 - 1
    return cols, signs


def index_matrix(h: np.ndarray) -> np.ndarray:
    cols, signs = index_pairs(h)
    out = np.zeros((len(h), DIM), np.float32)
    np.add.at(out, (np.arange(len(h))[:, None], cols), signs)
    return out


def context_sums(term: np.ndarray, doc: np.ndarray, known: np.ndarray, out: np.ndarray) -> None:
    """Add to out, for each known term (ascending hashes), the index vectors of the terms around it in its text."""
    at = np.minimum(np.searchsorted(known, term), len(known) - 1)
    row = np.where(known[at] == term, at, -1)
    cols, signs = index_pairs(term)
    for k in range(1, NEAR + 1):
        near = doc[:-k] == doc[k:]
        for here, there in ((slice(None, -k), slice(k, None)), (slice(k, None), slice(None, -k))):
            ok = near & (row[here] >= 0)
            np.add.at(out, (row[here][ok][:, None], cols[there][ok]), signs[there][ok])


class Pool:
    """Vectors of the known words and shapes; makes one vector of each text."""

    def __init__(self, known: list[np.ndarray], sums: list[np.ndarray]):
        self.known, self.vectors = known, []
        for h, v in zip(known, sums, strict=True):
            unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            self.vectors.append((unit + index_matrix(h) / np.sqrt(NONZERO)).astype(np.float32))

    def __call__(self, t: Texts) -> np.ndarray:
        word, shape, doc = terms(t)
        n = np.bincount(doc, minlength=t.n)
        size = np.maximum(n, 1)[:, None]
        out = []
        for term, known, vectors in zip((word, shape), self.known, self.vectors, strict=True):
            cols, signs = index_pairs(term)
            own = np.bincount((doc[:, None] * DIM + cols).ravel(), weights=signs.ravel(), minlength=t.n * DIM).reshape(t.n, DIM) / size
            around = own / np.sqrt(NONZERO)
            if len(known) and len(term):
                at = np.minimum(np.searchsorted(known, term), len(known) - 1)
                hit = np.flatnonzero(known[at] == term)
                pair, count = np.unique(doc[hit] * len(known) + at[hit], return_counts=True)
                if len(pair):
                    who, which = pair // len(known), pair % len(known)
                    first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
                    more = vectors[which] - index_matrix(known[which]) / np.sqrt(NONZERO)
                    around[who[first]] += np.add.reduceat(more * count[:, None], first, axis=0) / size[who[first]]
            out += [around, np.linalg.norm(own, axis=1, keepdims=True)]
        return np.concatenate((*out, np.log1p(n)[:, None] / 5), axis=1).astype(np.float32)


def loss_and_gradient(p: list[np.ndarray], x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Weighted cross-entropy of a network's logits (with a small ridge), and its gradient in every parameter."""
    h = np.tanh(x @ p[0] + p[1])
    logit = h @ p[2] + p[3]
    d = weight * (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - y)
    dh = d[:, None] * p[2] * (1 - h * h)
    loss = float(weight @ np.logaddexp(0, np.where(y == 1, -logit, logit))) + 5e-4 * (float((p[0] ** 2).sum()) + float((p[2] ** 2).sum()))
    return loss, [x.T @ dh + 1e-3 * p[0], dh.sum(axis=0), h.T @ d + 1e-3 * p[2], d.sum(keepdims=True)]


class Network:
    """Two layers and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7, steps: int = 400, rate: float = 0.01):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = (x - self.mean) / self.scale
        back = rng.random(len(x)) < 0.2  # for the temperature
        a, ya = z[~back], y[~back]
        weight = np.where(ya == 1, 0.5 / max(ya.mean(), 1e-6), 0.5 / max(1 - ya.mean(), 1e-6))
        weight /= weight.sum()
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(k) for k in p], [np.zeros_like(k) for k in p]
        for step in range(1, steps + 1):
            grads = loss_and_gradient(p, a, ya, weight)[1]
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        logit, yb = self.logit(x[back]), y[back]
        grid = np.exp(np.linspace(-2, 3, 101))
        losses = [np.mean(np.logaddexp(0, np.where(yb == 1, -1, 1) * logit / k)) for k in grid] if back.any() else [0.0]
        self.temperature = float(grid[int(np.argmin(losses))]) if back.any() else 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return (np.tanh(((x - self.mean) / self.scale) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]) / self.temperature

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -50, 50)))


def common_terms(picked: DataFrame, limit: int) -> list[np.ndarray]:
    """Hashes of the commonest words and shapes of the texts, counted by Spark; at most limit of each reach the driver."""

    def run(batches):
        for _, t in text_chunks(batches):
            for kind, h in enumerate(terms(t)[:2]):
                kinds, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind)), pa.array(kinds.view(np.int64)), pa.array(n)], ["kind", "h", "n"])

    counts = cut(mapped(picked, run, "kind long, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n")).filter("n > 1"))
    top = [counts.filter(F.col("kind") == k).orderBy(F.desc("n"), "h").limit(limit).select("h").toPandas() for k in range(2)]
    return [np.sort(x.h.to_numpy(np.int64).view(U)) for x in top]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", limit: int = TERMS) -> tuple[Pool, Network | None]:
    sample = cut(labels.filter(F.col("quality").isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("_id"), "quality").orderBy(F.xxhash64("_id"), "_id").limit(rows))
    found = docs.select(F.col(id_col).alias("_doc"), as_text(F.col("text")).alias("text"))
    picked = cut(found.join(F.broadcast(sample), F.col("_doc") == F.col("_id")).select(F.col("quality").cast("long").alias("quality"), "text"))
    known = common_terms(picked, limit)

    def contexts(batches):
        sums = [np.zeros((len(h), DIM), np.float32) for h in known]
        for _, t in text_chunks(batches):
            word, shape, doc = terms(t)
            for h, term, out in zip(known, (word, shape), sums, strict=True):
                if len(h) and len(term):
                    context_sums(term, doc, h, out)
        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in sums], pa.binary())], ["v"])

    # a few rows of a bounded size each: sums of whole numbers, the same in any order
    sums = [np.zeros((len(h), DIM), np.float32) for h in known]
    for row in mapped(picked.coalesce(4), contexts, "v binary").toPandas().v.to_numpy().reshape(-1, 2):
        for total, v in zip(sums, row, strict=True):
            total += np.frombuffer(v, np.float32).reshape(-1, DIM)
    pool = Pool(known, sums)

    def pooled(batches):
        for batch, t in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(list(pool(t)), pa.list_(pa.float32()))], ["y", "x"])

    data = mapped(picked, pooled, "y long, x array<float>").toPandas()
    if data.y.nunique() < 2:
        return pool, None
    x, y = np.stack(data.x.to_numpy()).astype(np.float64), (data.y > 0).to_numpy().astype(np.float64)
    order = np.lexsort((x[:, 0], x[:, DIM], x[:, -1], y))  # the same order whatever the tasks' order
    return pool, Network(x[order], y[order])


def score_quality(docs: DataFrame, pool: Pool, network: Network | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, held_out, score, predicted for each row; only the text is looked at."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((pool, network))

    def run(batches):
        p, net = shared.value
        for batch, t in text_chunks(batches):
            s = net.score(p(t)) if net is not None else np.full(t.n, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), as_text(F.col(text)).alias("text"))
    return mapped(rows, run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
