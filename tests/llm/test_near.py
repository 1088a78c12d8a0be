import random
import re

import numpy as np

from boxwright.llm import near
from boxwright.llm.components import components


def brute(rows, percent=75):
    def words(t):
        return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                c = len(sets[a] & sets[b])
                if 100 * c >= percent * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus():
    rnd = random.Random(4)
    vocab = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(60, 200))]
        for k in range(rnd.randint(1, 14)):
            t = list(base)
            for _ in range(rnd.choice([0, 1, 2, 3, 5])):
                t[rnd.randrange(len(t))] = rnd.choice(vocab)
            rows.append(" ".join(t).upper() if k % 3 == 0 else "  ".join(t))
    # a chain: each is linked with the next only
    base = [f"c{k}" for k in range(150)]
    rows += [" ".join(base[k * 6 : k * 6 + 80]) for k in range(10)]
    rows += ["one two", "One\ttwo", "one two three four", None, "", "  \n ", "x " * 3000, "é É", "É É"]
    rnd.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


def test_components_equal_brute_force(spark):
    rows = corpus()
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int")
    got = {r.doc_id: r for r in near.near_groups(d).collect()}
    want = brute(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    kept = near.near_dedup(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_repeated_rows_null_ids_and_empty_table(spark):
    t = " ".join(f"a{k}" for k in range(40))
    d = spark.createDataFrame([(5, t), (5, t), (None, t), (None, "alone here"), (9, t + " z")], "doc_id long, text string")
    got = sorted(((str(r.doc_id), r.component_id, r.kept) for r in near.near_groups(d).collect()), key=str)
    assert got == sorted([("5", 5, True), ("5", 5, True), ("9", 5, False), ("None", 5, False), ("None", None, True)], key=str)
    assert near.near_groups(d.limit(0)).count() == 0


def test_likelihood_keeps_what_reaches_the_threshold():
    rng = np.random.default_rng(2)
    for j, want in ((0.8, 1.0), (0.2, 0.0)):
        ok = []
        for _ in range(60):
            n = 400
            common = int(round(2 * n * j / (1 + j)))
            x = rng.integers(0, 1 << 63, 2 * n - common).astype(np.uint64)
            a, b = near.registers(x[:n]), near.registers(x[n - common :])
            ok.append(near.may_reach(a[None], b[None], np.array([float(n)]), np.array([float(n)]), 0.75)[0])
        assert np.mean(ok) == want


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(1, 24)] + [(1000, k) for k in range(1001, 1100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(2, 25)} | {k: 1000 for k in range(1001, 1100)}


def test_leading_components_in_blocks_equal_brute_force(spark, monkeypatch):
    """Two large families that are close but mostly no links, with small blocks and low bounds of leadership."""
    monkeypatch.setattr(near, "LEAD", 3)
    monkeypatch.setattr(near, "PIVOT_ROUNDS", 0)
    monkeypatch.setattr(near, "BLOCK_SETS", 7)
    rnd = random.Random(9)
    base = [f"b{k}" for k in range(160)]
    far = base[:120] + [f"f{k}" for k in range(40)]
    rows = []
    for k in range(90):
        t = list(base if k % 2 else far)
        for _ in range(rnd.randint(0, 6)):
            t[rnd.randrange(len(t))] = f"n{rnd.randrange(900)}"
        rows.append((k, " ".join(t)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_groups(d).collect()}
    assert got == brute(rows)


def test_common_sizes_equal_set_intersections():
    rng = np.random.default_rng(5)
    a, b = ([np.unique(rng.integers(0, 300, n)) for n in sizes] for sizes in ((0, 40, 200, 7), (90, 0, 250)))
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert near.common_sizes(a, b, step=16).tolist() == want
    assert near.common_sizes([], b).shape == (0, 3)
