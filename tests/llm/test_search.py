import math
import random
import re
from collections import Counter

import pytest

from boxwright.llm import search

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
DOCS = "doc_id long, text string, terms string, score long, row string"


def terms(text):
    fold = {c: c + 32 for c in range(65, 91)}
    return TERM.findall((text or "").translate(fold))


def ranking(docs, queries, k=10):
    """Every document scored for every query."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    many, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in queries:
        asked = Counter(terms(text))
        scored = []
        for i, b in bags:
            m = 100 - 75 + (75 * sum(b.values()) * many) // length
            s = sum(n * math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m)) for t, n in asked.items() if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return Counter(out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["The", "of", "ÉCOLE", "école", "42", "naïve", "日本語", "x_y", "a-b", "rare", *[f"w{i}" for i in range(60)]]
    pick = lambda n: " ".join(rng.choice(words[: rng.randint(3, len(words))]) for _ in range(n))
    docs = [(i, pick(rng.randint(0, 60))) for i in range(400)]
    docs += [(900, None), (901, ""), (902, " .,;-"), (903, "rare " * 3000), (None, "rare 42"), (904, "w1 w2 w3"), (904, "w1 w2 w3"), (905, "\x00w1\x7fw2 w3{w4}")]
    docs += [(1000 + i, "same copies of the RARE text w7 w8") for i in range(30)]
    queries = [(i, pick(rng.randint(1, 12))) for i in range(40)] + [(50, None), (51, "!!"), (52, "unseen"), (53, "rare rare RARE text"), (53, "w1 w2"), (54, "the " * 40), (None, "42")]
    return docs, queries


def found(spark, docs, queries, **options):
    d = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in docs], DOCS)
    q = spark.createDataFrame([(i, t, 0) for i, t in queries], "item_id long, text string, query int")
    index, many, length = search.build_index(d.repartition(3))
    return index, search.search(index, many, length, q, **options)


@pytest.mark.parametrize("k", [1, 10])
def test_ranking_against_every_score(spark, k):
    docs, queries = corpus(k)
    index, out = found(spark, docs, queries, k=k)
    assert index.count() == sum(bool(terms(t)) for _, t in docs)
    rows = out.collect()
    assert Counter((r.item_id, r.rank, r.doc_id, r.score) for r in rows) == ranking(docs, queries, k)
    assert all(r.candidates >= k or r.rank <= r.candidates for r in rows)


def test_blocks_of_queries_and_small_batches(spark, monkeypatch):
    docs, queries = corpus(3)
    monkeypatch.setattr(search, "BLOCK", 7)
    monkeypatch.setattr(search, "AT_ONCE", 60)
    monkeypatch.setattr(search, "BROADCAST", 0)
    _, out = found(spark, docs, queries)
    assert Counter((r.item_id, r.rank, r.doc_id, r.score) for r in out.collect()) == ranking(docs, queries)


def test_bounds_hold_and_leave_most_documents_unscored(spark):
    docs = [(i, " ".join(f"w{(i * j) % 97}" for j in range(1, 30))) for i in range(2000)]
    queries = [(0, "w5 w8 w13 w21"), (1, docs[77][1])]
    _, out = found(spark, docs, queries)
    rows = out.collect()
    assert Counter((r.item_id, r.rank, r.doc_id, r.score) for r in rows) == ranking(docs, queries)
    assert max(r.candidates for r in rows if r.item_id == 1) < 400


def test_empty_tables(spark):
    for docs, queries in (([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")])):
        assert found(spark, docs, queries)[1].collect() == []
