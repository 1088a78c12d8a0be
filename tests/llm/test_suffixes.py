import hashlib
import random
from collections import Counter

import numpy as np

from boxwright.llm import suffixes


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


def corpus():
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(5, 40)))
    common = [word() * 2 for _ in range(6)]
    texts = []
    for k in range(120):
        parts = [word() for _ in range(rnd.randint(0, 4))]
        for _ in range(rnd.randint(0, 2)):
            parts.insert(rnd.randint(0, len(parts)), rnd.choice(common))
        texts.append("".join(parts))
    return [*texts, "x" * 300, "ab" * 90, "", None, texts[3], texts[3], "abc" * 40 + "q", "x" * 21]


def test_difference_cover_order():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 4, 5, 30, 200, 1500):
        for top in (2, 4, 200):
            s = rng.integers(1, top + 1, n)
            rank = suffixes.suffix_ranks(s, 10**6)
            want = sorted(range(n), key=lambda i: s[i:].tolist())
            assert np.argsort(rank, kind="stable").tolist() == want


def test_removal_equals_brute_force(spark):
    texts = corpus()
    d = spark.createDataFrame([(i, t, "u") for i, t in enumerate(texts)], "doc_id long, text string, uid string")
    want = brute([(t or "").encode() for t in texts], 20)
    for hot in (10**9, 1):
        got = {r.doc_id: r for r in suffixes.suffix_dedup(d, 20, 7, hot=hot).collect()}
        assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == want


def test_repeated_ids_and_empty_table(spark):
    d = spark.createDataFrame([(1, "y" + "abcdefgh" * 5), (1, "z" + "abcdefgh" * 5), (None, "short")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in suffixes.suffix_dedup(d, 20, 7).collect())
    assert got == [("1", 40), ("1", 40), ("None", 0)]
    assert suffixes.suffix_dedup(d.limit(0)).count() == 0
