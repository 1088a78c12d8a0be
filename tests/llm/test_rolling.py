"""Strings built against polynomial hashes: a Thue-Morse word and its complement."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from boxwright.llm import near, queries, rules, tokens
from boxwright.llm.common import Texts
from boxwright.llm.rolling import Prefix


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def texts(*rows):
    return Texts(pa.array(list(rows)))


@pytest.mark.parametrize("size", [64, 256, 1024, 2048, 4096])
@pytest.mark.parametrize("seed", [11, 23])
def test_complements_differ(size, seed):
    a, b = thue_morse(size).encode(), thue_morse(size, "b", "a").encode()
    buf = np.frombuffer(a + b, np.uint8)
    p = Prefix(buf, seed)
    h = p.of(np.array([0, size]), np.array([size, 2 * size]))
    w = p.windows(size)
    assert h[0] != h[1] and w[0] != w[size]


def test_equal_substrings_hash_alike_wherever_they_stand():
    rnd = random.Random(1)
    buf = np.frombuffer(bytes(rnd.choice(b"abc") for _ in range(900)), np.uint8)
    p = Prefix(buf)
    at = [(rnd.randrange(800), rnd.randint(0, 100)) for _ in range(3000)]
    s = np.array([a for a, _ in at])
    e = s + np.array([n for _, n in at])
    h = p.of(s, e)
    own = {}
    for i in range(len(s)):
        own.setdefault(buf[s[i] : e[i]].tobytes(), set()).add(int(h[i]))
    assert all(len(v) == 1 for v in own.values()) and len({x for v in own.values() for x in v}) == len(own)
    w = p.windows(70)
    assert len({buf[i : i + 70].tobytes() for i in range(len(w))}) == len(np.unique(w))


@pytest.mark.parametrize("size", [1024, 2048])
def test_operators_tell_complements_apart(spark, size):
    a, b = thue_morse(size), thue_morse(size, "b", "a")
    rows = [(1, a), (2, b), (3, " ".join([a, "x", "y", "z", "w"])), (4, " ".join([b, "x", "y", "z", "w"]))]
    got = {r.doc_id: r for r in near.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].component_id for i in (1, 2, 3, 4)] == [1, 2, 3, 4]
    lib = Tokenizer.from_file(queries.vocabulary_path())
    pairs = [f"{a} {b}", f"{b} {a} {a}"]
    n, ids = tokens.Vocabulary(queries.vocabulary_path()).encode(texts(*pairs), True)
    for text, k, x in zip(pairs, n, ids, strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        assert k == len(want) and x.tolist() == want
    lines = rules.analyse(texts(f"{a} q\n{b} q\n", " ".join([a, *"cdefghi", b, *"cdefghi"])))
    assert lines["n_dup_lines"].tolist() == [0, 0] and lines["n_repeat_words"].tolist() == [0, 0]
