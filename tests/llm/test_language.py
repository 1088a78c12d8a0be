import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from boxwright.llm import language
from boxwright.llm.common import Texts


def lowered(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())


class Naive:
    """One language's tree as dictionaries, walked byte by byte."""

    def __init__(self, texts):
        self.seen = defaultdict(Counter)
        for t in texts:
            b = lowered(t)
            for i in range(len(b)):
                for k in range(min(i, language.ORDER) + 1):
                    self.seen[b[i - k : i]][b[i]] += 1

    def probability(self, context, byte):
        p, out = 1.0, set()
        while True:
            here = {x: n for x, n in self.seen.get(context, {}).items() if x not in out}
            whole = sum(here.values()) + len(here)
            if byte in here:
                return p * here[byte] / whole
            if here:
                p *= len(here) / whole
            out |= set(here)
            if not context:
                return p / (256 - len(out))
            context = context[1:]

    def bits(self, text):
        b = lowered(text)
        return -sum(math.log2(self.probability(b[max(0, i - language.ORDER) : i], b[i])) for i in range(len(b)))


TRAIN = {"aa": ["banana bandana", "An apple, a banana.", "é", ""], "bb": ["zyx wvu zyx", "tsr qpo zzz"], "cc": ["x"]}


@pytest.fixture(scope="module")
def model():
    rows = Counter()
    for j, texts in enumerate(TRAIN.values()):
        t = Texts(pa.array(texts))
        for k, g in enumerate(language.grams(t)):
            rows.update((j, k, int(x)) for x in g[g >= 0])
    return language.Model(list(TRAIN), pd.DataFrame([(*key, n) for key, n in rows.items()], columns=["lang", "k", "gram", "n"]))


def test_code_lengths_equal_a_walk_over_the_trees(model):
    rnd = random.Random(2)
    texts = ["", "b", "Banana", "zyx banana", "été", "naïve Bandana wvu", *("".join(rnd.choice("abnxyz é.") for _ in range(rnd.randint(1, 60))) for _ in range(25))]
    got = model.code_lengths(Texts(pa.array(texts)))
    want = np.array([[Naive(v).bits(t) for v in TRAIN.values()] for t in texts])
    assert np.allclose(got, want, atol=1e-3)


def test_code_lengths_are_those_of_a_distribution(model):
    for k in range(language.ORDER + 1):
        for context in (b"ban", b"nan", b"zyx", b"\xffab", b"qqq", b" ba"):
            code = int.from_bytes(context[3 - k :], "big")
            bits = model.lengths(k, (code << 8) + np.arange(256))
            assert np.allclose(np.exp2(-bits).sum(axis=0), 1, atol=1e-6)


def test_training_rows_are_bounded_and_never_held_out(spark):
    d = spark.createDataFrame([(i, f"t{i}", "en" if i % 3 else "fr") for i in range(3000)], "doc_id long, text string, lang string")
    got = language.training_sample(d, "doc_id", 100).collect()
    assert Counter(r.lang for r in got) == {"en": 100, "fr": 100}
    out = {r.text for r in d.filter(language.held_out()).collect()}
    assert not out & {r.text for r in got}


def test_edges(spark):
    d = spark.createDataFrame([(1, "a banana", "aa", 1), (1, "a banana", "aa", 2), (None, "zyx", "bb", 3), (3, "word " * 40_000, None, 4), (4, None, None, 5)], "doc_id long, text string, lang string, score int")
    m = language.train(d)
    got = language.identify(d, m).collect()
    assert len(got) == 5 and len({(r.doc_id, r.lang_pred, r.score) for r in got if r.doc_id == 1}) == 1
    assert {r.lang_pred for r in got if r.doc_id == 4} == {"und"}
    assert language.identify(d.limit(0), m).count() == 0 and language.train(d.limit(0)) is None
