import re

import numpy as np
import pyarrow as pa

from boxwright.llm import classify
from boxwright.llm.common import Texts
from boxwright.llm.rolling import U

TEXTS = ["The cat sat on the mat the cat", "", "x", "A $$ b$$ c$$ the cat sat", "é É 12 ab12 the"]


def test_vectors_equal_brute_force():
    t = Texts(pa.array(TEXTS))
    word, shape, doc = classify.terms(t)
    known = [np.unique(word)[:6], np.unique(shape)]
    sums = [np.zeros((len(h), classify.DIM), np.float32) for h in known]
    for h, term, out in zip(known, (word, shape), sums, strict=True):
        classify.context_sums(term, doc, h, out)
    index = lambda h: classify.index_matrix(np.array([h], U))[0]
    tokens = [re.findall("[^\x20\x09-\x0d]+", x) for x in TEXTS]
    assert [len(x) for x in tokens] == np.bincount(doc, minlength=len(TEXTS)).tolist()
    pooled = classify.Pool(known, sums)(t)
    for kind, (term, h) in enumerate(zip((word, shape), known, strict=True)):
        want = {int(x): np.zeros(classify.DIM) for x in h}
        for i in range(len(term)):
            for j in range(max(0, i - classify.NEAR), min(len(term), i + classify.NEAR + 1)):
                if j != i and doc[j] == doc[i] and int(term[i]) in want:
                    want[int(term[i])] += index(term[j])
        assert all(np.allclose(sums[kind][k], want[int(x)]) for k, x in enumerate(h))
        unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
        lo = kind * (classify.DIM + 1)
        for d in range(len(TEXTS)):
            mine = [int(x) for x in term[doc == d]]
            mean = sum((unit(want[x]) if x in want else 0) + index(x) / np.sqrt(classify.NONZERO) for x in mine) / max(len(mine), 1)
            assert np.allclose(pooled[d, lo : lo + classify.DIM], mean, atol=1e-4)


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(20, 6)), (rng.random(20) < 0.5).astype(float)
    p = [rng.normal(size=(6, 4)), rng.normal(size=4), rng.normal(size=4), rng.normal(size=1)]
    w = rng.random(20)
    w /= w.sum()
    loss, grads = classify.loss_and_gradient(p, x, y, w)
    for i in range(4):
        for at in np.ndindex(p[i].shape):
            q = [k.copy() for k in p]
            q[i][at] += 1e-6
            assert abs((classify.loss_and_gradient(q, x, y, w)[0] - loss) / 1e-6 - grads[i][at]) < 1e-4


def test_edges(spark):
    rows = [(i, t, 1) for i, t in enumerate((TEXTS + [None, "w " * 60_000]) * 6)] + [(None, "a b", 1), (5, "again", 2)]
    d = spark.createDataFrame(rows, "doc_id long, text string, score int")
    lab = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1)], "doc_id long, quality int")
    pool, net = classify.train(d, lab)
    got = classify.score_quality(d, pool, net).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert classify.score_quality(d.limit(0), pool, net).count() == 0
    assert classify.train(d, lab.limit(0))[1] is None
    assert {r.score for r in classify.score_quality(d, *classify.train(d.limit(0), lab)).collect()} == {0.5}
