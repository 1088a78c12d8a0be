import numpy as np
import pyarrow as pa
import pytest

from boxwright.llm import rules
from boxwright.llm.common import Texts

GOOD = "Once there was a river, and along it stood a mill."
JUNK = "| HOME | SHOP | 24% OFF !! | $$$ ### |"


def sample():
    rng = np.random.default_rng(1)
    x, group = rng.normal(size=(37, 3)), np.sort(rng.integers(0, 4, 37))
    label = rng.integers(0, 2, 37)
    return rules.runs(x, group, label), rng


def test_likelihood_equals_enumeration_and_its_gradient_finite_differences(monkeypatch):
    monkeypatch.setattr(rules, "RUN", 6)
    (X, Y, M), rng = sample()
    theta, weight = rng.normal(size=3 * 2 + 4), rng.random(len(X))
    value, grad = rules.likelihood(theta, X, Y, M, weight)
    W, T = theta[:6].reshape(3, 2), theta[6:].reshape(2, 2)
    want = 0.0
    for x, y, m, w in zip(X, Y, M, weight, strict=True):
        n = int(m.sum())
        score = lambda p, s=(x @ W)[:n]: sum(s[k, p[k]] for k in range(len(p))) + sum(T[a, b] for a, b in zip(p, p[1:]))
        every = [score([(c >> k) & 1 for k in range(n)]) for c in range(2**n)]
        want += w * (score(list(y[:n])) - np.log(np.exp(every).sum()))
    assert value == pytest.approx(want)
    for i in range(len(theta)):
        moved = theta.copy()
        moved[i] += 1e-6
        assert (rules.likelihood(moved, X, Y, M, weight)[0] - value) / 1e-6 == pytest.approx(grad[i], abs=1e-4)


def documents(n=60):
    out = []
    for i in range(n):
        if i % 3:
            out.append((i, "\n".join(f"{GOOD} It was the year {1800 + i}." for _ in range(3 + i % 4)), 1))
        else:  # mixed: some lines are like those of good documents
            lines = [f"{GOOD} Then came the year {1900 + i}."] * (i % 4) + [JUNK + f" {i}"] * 4
            out.append((i, "\n".join(lines), 0))
    return out


def test_lines_of_bad_documents_are_told_apart(spark):
    rows = documents()
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    crf = rules.train(d, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int"))
    text = "\n".join([GOOD] * 3 + [JUNK + " x"] * 3 + [GOOD] * 3)
    a, share = rules.verdict(Texts(pa.array([text, *(r[1] for r in rows)])), crf)
    labels = crf.decode(a["x"], a["line_doc"])
    assert labels[:9].tolist() == [1, 1, 1, 0, 0, 0, 1, 1, 1] and 0 < share[0] < 1
    mixed = [s for s, r in zip(share[1:], rows, strict=True) if not r[2] and r[0] % 4 > 1]  # a lone line may follow its neighbours
    assert mixed and all(0 < s < 1 for s in mixed)
    assert all(s == 1 for s, r in zip(share[1:], rows, strict=True) if r[2])


def test_a_bad_document_holds_a_line_of_boilerplate():
    x = np.ones((6, 2))
    y = rules.line_labels(x, np.array([0, 0, 1, 1, 2, 2]), np.array([True, True, False, False, True, True]))
    assert y[:2].all() and y[4:].all() and not y[2:4].all()


def test_edges(spark):
    d = spark.createDataFrame([("a", "x " * 50_000, 1), ("b", None, 2), (None, GOOD * 3, 3), ("a", "x y", 4)], "doc_id string, text string, n_words int")
    labels = spark.createDataFrame([("a", 1), ("b", 0), (None, 0)], "doc_id string, quality int")
    crf = rules.train(d, labels)
    got = rules.judge(d, crf).collect()
    assert len(got) == 4 and {r.doc_id for r in got} == {"a", "b", None}
    assert rules.keep_good(d, crf).columns == d.columns
    assert rules.judge(d.limit(0), crf).count() == 0 and rules.train(d, labels.limit(0)) is None and rules.train(d.limit(0), labels) is None
