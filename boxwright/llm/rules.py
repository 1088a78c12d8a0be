"""Quality rules (operator 9): base rules on words, then a line labeller whose content share decides.

A linear-chain conditional random field labels each line content or boilerplate. A line's features are shares of
its characters and words (see FEATURES). It is trained on the lines of at most TRAIN_DOCS labelled documents, at most
DOC_LINES lines of each, in runs of RUN lines. Only documents are labelled, so the lines' labels are found first:
lines of good documents are content; a bad document holds one line of boilerplate at least, and its other lines are
what a classifier of single lines takes them for, which is fitted and applied in turns (LABEL_TURNS). So sequences
with both labels teach the transitions. Weights and transitions maximise the likelihood of these labels. Viterbi
decoding gives the best labelling of each text, and a document is kept if lines of content hold at least SHARE of its
words.

Defined results: null and empty texts have no words and fail the base rules; without labels the line labeller
keeps everything; ties in the labelling go to content; rows that repeat are judged each; ids may be of any type and
null; an empty table gives an empty table; other columns are ignored (keep_good keeps them, whatever their names).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, as_text, cut, mapped, text_chunks
from .rolling import Prefix, U, mix, runs_within, splitmix, words

TRAIN_DOCS, DOC_LINES = 2000, 96
RUN = 24
LABEL_TURNS = 3
SHARE = 0.5
WINDOW = 8
FEATURES = ("bias", "few words", "symbols a word", "pipes a word", "upper case", "digits", "exclamation", "repeated line", "repeated words", "long words", "ends a sentence", "alike words")

_Q = splitmix(404, WINDOW) | U(1)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_KINDS = {"upper": range(65, 91), "digit": range(48, 58), "pipe": b"|", "mark": b"!", "letter": [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]}
_IS = {k: np.isin(np.arange(256), list(v)) for k, v in _KINDS.items()}


def _sums(flag: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=out[1:])
    return out


def analyse(t: Texts) -> dict:
    """Counts of each text, and features of each line that has a word."""
    b = t.buf
    s, e, doc = words(b, t.starts, t.ends)
    n_words = np.bincount(doc, minlength=t.n)
    lead, symbols = _sums((b & 0xC0) != 0x80), _sums(_SYMBOL[b])
    chars = np.bincount(doc, weights=lead[e] - lead[s], minlength=t.n).astype(np.int64)
    prefix = Prefix(b)
    h = prefix.of(s, e)
    # words in windows that the text holds twice or more
    at = runs_within(doc, WINDOW)
    repeated = np.zeros(len(s) + 1, np.int64)
    if len(at):
        g = np.zeros(len(at), U)
        for k in range(WINDOW):
            g += h[at + k] * _Q[k]
        _, back, n = np.unique(mix(mix(g) + doc[at].astype(U) * _Q[0]), return_inverse=True, return_counts=True)
        twice = at[n[back] > 1]
        np.add.at(repeated, twice, 1)
        np.add.at(repeated, np.minimum(twice + WINDOW, len(s)), -1)
    covered = (np.cumsum(repeated[:-1]) > 0) if len(s) else np.zeros(0, bool)
    # lines
    breaks = np.flatnonzero(b == 10)
    some = t.starts < t.ends
    line_s = np.sort(np.concatenate((t.starts[some], breaks[~np.isin(breaks + 1, t.ends)] + 1)))
    line_s = np.unique(line_s)
    line_doc = np.searchsorted(t.ends, line_s, side="right")
    stop = np.concatenate((line_s[1:], [len(b)]))[: len(line_s)]
    cut_at = np.minimum(stop, t.ends[line_doc])
    line_e = np.where((cut_at > line_s) & (b[np.maximum(cut_at - 1, 0)] == 10), cut_at - 1, cut_at)
    w0, w1 = np.searchsorted(s, line_s), np.searchsorted(s, line_e)
    has = w1 > w0
    line_s, line_e, line_doc, w0, w1 = line_s[has], line_e[has], line_doc[has], w0[has], w1[has]
    key = mix(prefix.of(line_s, line_e) + line_doc.astype(U) * _Q[1])
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    again = first[back] != np.arange(len(key))
    nw = (w1 - w0).astype(float)
    size = np.maximum(line_e - line_s, 1).astype(float)
    inside = lambda name: (lambda c: c[line_e] - c[line_s])(_sums(_IS[name][b]))
    letters = np.maximum(inside("letter"), 1)
    cov, run_ = _sums(covered), _sums(np.concatenate(([False], h[1:] == h[:-1])) if len(h) else np.zeros(0, bool))
    last = b[np.maximum(line_e - 1, 0)] if len(b) else np.zeros(0, np.uint8)
    x = np.stack(
        [
            np.ones(len(nw)),
            nw < 4,
            np.minimum((symbols[line_e] - symbols[line_s]) / nw, 4) / 4,
            np.minimum(inside("pipe") / nw, 1),
            inside("upper") / letters,
            inside("digit") / size,
            np.minimum(inside("mark") / nw, 2) / 2,
            again,
            (cov[w1] - cov[w0]) / nw,
            np.minimum(size / nw / 20, 2),
            np.isin(last, np.frombuffer(b".!?", np.uint8)),
            (run_[w1] - run_[w0]) / nw,
        ],
        axis=1,
    ).astype(np.float64) if len(nw) else np.zeros((0, len(FEATURES)))
    return {
        "n_words": n_words,
        "word_chars": chars,
        "n_symbols": symbols[t.ends] - symbols[t.starts],
        "n_dup_lines": np.bincount(line_doc[again], minlength=t.n),
        "n_repeat_words": np.bincount(doc[covered], minlength=t.n),
        "line_doc": line_doc,
        "line_words": nw,
        "x": x,
    }


class Crf:
    """Two labels (0 boilerplate, 1 content): scores x @ weights per label, and 2 x 2 transitions."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def decode(self, x: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Viterbi labels of every line; group (sorted) says which text a line is of."""
        n = len(group)
        labels = np.ones(n, np.int8)
        if not n:
            return labels
        score = x @ self.weights
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        sizes = np.diff(np.concatenate((starts, [n])))
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        back = np.zeros((n, 2), np.int8)
        best = score[starts].copy()
        for k in range(1, int(sizes[0])):  # all texts that have a line k, at once
            m = int(np.searchsorted(-sizes, -k, side="left"))
            at = starts[:m] + k
            come = best[:m, :, None] + self.moves[None]
            back[at] = np.where(come[:, 1, :] >= come[:, 0, :], 1, 0)
            best[:m] = come.max(axis=1) + score[at]
        now = np.where(best[:, 1] >= best[:, 0], 1, 0).astype(np.int8)
        for k in range(int(sizes[0]) - 1, -1, -1):
            m = int(np.searchsorted(-sizes, -k, side="left"))
            at = starts[:m] + k
            labels[at] = now[:m]
            if k:
                now[:m] = back[at, now[:m]]
        return labels


def line_labels(x: np.ndarray, group: np.ndarray, good: np.ndarray, turns: int = LABEL_TURNS) -> np.ndarray:
    """Labels of lines (1 content) from those of their documents (group is sorted): see the module's text."""
    y = good.astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    for _ in range(turns):
        p = x @ _logistic(x, y)
        y = np.where(good | (p > 0), 1, 0)
        low = np.minimum.reduceat(p, starts)
        least = np.flatnonzero(p == np.repeat(low, np.diff(np.concatenate((starts, [len(p)])))))
        y[least[~good[least]]] = 0
    return y


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 25, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression, both classes weighing the same (Newton steps)."""
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(curve, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def runs(x: np.ndarray, group: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines as padded runs of RUN: features, labels, and which places hold a line."""
    place = np.arange(len(group)) - np.maximum.accumulate(np.where(np.concatenate(([True], group[1:] != group[:-1])), np.arange(len(group)), 0))
    run_id = np.cumsum((place % RUN == 0)) - 1
    n, col = int(run_id[-1]) + 1, place % RUN
    X, Y, M = np.zeros((n, RUN, x.shape[1])), np.zeros((n, RUN), np.int64), np.zeros((n, RUN))
    X[run_id, col], Y[run_id, col], M[run_id, col] = x, label, 1.0
    return X, Y, M


def likelihood(theta: np.ndarray, X: np.ndarray, Y: np.ndarray, M: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted log-likelihood of the runs' labels and its gradient, by forward and backward sums."""
    d, width = X.shape[2], X.shape[1]
    W, T = theta[: 2 * d].reshape(d, 2), theta[2 * d :].reshape(2, 2)
    S = X @ W
    a, b = np.zeros_like(S), np.zeros_like(S)
    a[:, 0] = S[:, 0]
    for k in range(1, width):
        nxt = np.logaddexp(a[:, k - 1, 0, None] + T[0], a[:, k - 1, 1, None] + T[1]) + S[:, k]
        a[:, k] = np.where(M[:, k, None] > 0, nxt, a[:, k - 1])
    for k in range(width - 2, -1, -1):
        into = S[:, k + 1] + b[:, k + 1]
        prv = np.logaddexp(T[:, 0][None] + into[:, 0, None], T[:, 1][None] + into[:, 1, None])
        b[:, k] = np.where(M[:, k + 1, None] > 0, prv, 0)
    z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
    p = np.exp(a + b - z[:, None, None]) * M[..., None]
    q = np.exp(a[:, :-1, :, None] + T + (S[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * M[:, 1:, None, None]
    own = np.eye(2)[Y] * M[..., None]
    pairs = (own[:, :-1, :, None] * own[:, 1:, None, :]).sum(axis=1)
    value = float(weight @ ((own * S).sum(axis=(1, 2)) + (pairs * T).sum(axis=(1, 2)) - z))
    grad = np.concatenate((np.einsum("n,nkd,nkl->dl", weight, X, own - p).ravel(), np.einsum("n,nij->ij", weight, pairs - q.sum(axis=1)).ravel()))
    return value, grad


def fit(x: np.ndarray, group: np.ndarray, label: np.ndarray, steps: int = 120, rate: float = 0.08) -> Crf:
    """The field of the greatest likelihood (Adam), runs with and without boilerplate weighing the same."""
    X, Y, M = runs(x, group, label)
    poor = (Y * M).sum(axis=1) < M.sum(axis=1)
    share = float(np.clip(poor.mean(), 1e-6, 1 - 1e-6))
    weight = np.where(poor, 0.5 / share, 0.5 / (1 - share)) / len(poor)
    theta = np.zeros(x.shape[1] * 2 + 4)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        g = likelihood(theta, X, Y, M, weight)[1] - 1e-3 * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        theta = theta + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    d = x.shape[1]
    return Crf(theta[: 2 * d].reshape(d, 2), theta[2 * d :].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_DOCS, id_col: str = "doc_id", text: str = "text") -> Crf | None:
    """A field fitted on a bounded sample: the rows labelled documents with the smallest hash of their id.

    Of a document with more than DOC_LINES lines, runs at even distances. At most rows * DOC_LINES lines reach the driver.
    """
    sample = cut(labels.filter("quality is not null").select(F.col(id_col).alias("_id"), "quality").orderBy(F.xxhash64("_id"), "_id").limit(rows))
    found = docs.select(F.col(id_col).alias("_doc"), as_text(F.col(text)).alias("text"))
    picked = found.join(F.broadcast(sample), F.col("_doc") == F.col("_id")).select(F.xxhash64("_id").alias("id"), F.col("quality").cast("long").alias("quality"), "text")

    def run(batches):
        for batch, t in text_chunks(batches):
            a = analyse(t)
            bounds = np.searchsorted(a["line_doc"], np.arange(t.n + 1))
            x = []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                at = np.arange(lo, hi)
                if hi - lo > DOC_LINES:
                    first = np.linspace(0, hi - lo - RUN, DOC_LINES // RUN).astype(np.int64)
                    at = lo + np.unique(first[:, None] + np.arange(RUN))
                x.append(a["x"][at].astype(np.float32).ravel())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("quality"), pa.array(x, pa.list_(pa.float32()))], ["id", "q", "x"])

    found = mapped(picked, run, "id long, q long, x array<float>").toPandas()
    found = found[found.x.map(len) > 0].sort_values("id", kind="stable")
    if found.q.nunique() < 2:
        return None
    lines = [np.asarray(v, np.float64).reshape(-1, len(FEATURES)) for v in found.x]
    group = np.repeat(np.arange(len(lines)), [len(v) for v in lines])
    x, good = np.concatenate(lines), (found.q.to_numpy() > 0)[group]
    return fit(x, group, line_labels(x, group, good))


def judge(docs: DataFrame, crf: Crf | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, the counts, base_failed, content_share and kept for each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for batch, t in text_chunks(batches):
            a, share = verdict(t, shared.value)
            failed = (a["n_words"] < 20) | (100 * a["n_repeat_words"] > 30 * a["n_words"])
            cols = [batch.column(0), *[pa.array(a[c].astype(np.int64)) for c in names], pa.array(failed), pa.array(share), pa.array(~failed & (share >= SHARE))]
            yield pa.RecordBatch.from_arrays(cols, ["id", *names, "base_failed", "content_share", "kept"])

    rows = docs.select(F.col(id_col).alias("id"), as_text(F.col(text)).alias("text"))
    schema = f"id {kind}, " + ", ".join(f"{c} long" for c in names) + ", base_failed boolean, content_share double, kept boolean"
    return mapped(rows, run, schema).withColumnRenamed("id", id_col)


def verdict(t: Texts, crf: Crf | None) -> tuple[dict, np.ndarray]:
    """The counts of each text and the share of its words that stand in lines of content."""
    a = analyse(t)
    good = crf.decode(a["x"], a["line_doc"]) if crf is not None else np.ones(len(a["line_doc"]), np.int8)
    content = np.bincount(a["line_doc"], weights=a["line_words"] * good, minlength=t.n)
    return a, content / np.maximum(a["n_words"], 1)


def keep_good(docs: DataFrame, crf: Crf | None, text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches):
        for batch, t in text_chunks(batches, text):
            a, share = verdict(t, shared.value)
            failed = (a["n_words"] < 20) | (100 * a["n_repeat_words"] > 30 * a["n_words"])
            yield batch.filter(pa.array(~failed & (share >= SHARE)))

    return mapped(docs, run, docs.schema)
