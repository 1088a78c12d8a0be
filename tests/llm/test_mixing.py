from collections import defaultdict

from boxwright.llm import mixing


def test_skewed_weights_are_kept_over_many_periods(spark):
    """Against the weights as given, not rounded to shares of 1000 slots."""
    given = {"a": 0.5, "tiny": 0.0001} | {f"s{i:02}": 0.4999 / 18 for i in range(18)}
    sizes = {"a": 1900, "tiny": 3} | {f"s{i:02}": 110 for i in range(18)}
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))], "doc_id long, source string")
    got = mixing.mix_sources(docs, spark.createDataFrame(list(given.items()), "source_name string, weight double"), block_docs=1).collect()
    assert len(got) == len({r.slot for r in got}) == len({r.doc_id for r in got}) == sum(sizes.values())
    ran = {r.slot: r.source_name for r in got}
    horizon = sum(r.on_target for r in got)
    assert horizon > 3500 and sorted(ran) == list(range(len(got)))
    done = defaultdict(int)
    for t in range(horizon):
        done[ran[t]] += 1
        assert all(abs(done[s] - w * (t + 1)) < 1 + 1e-6 for s, w in given.items())
    for s, n in sizes.items():
        assert [r.block for r in sorted((r for r in got if r.source_name == s), key=lambda r: r.slot)] == list(range(n))


def naive(weights, blocks):
    """Earliest deadline first, slot by slot, in whole numbers of a common weight."""
    names, total = sorted(weights), sum(weights.values())
    done, out = dict.fromkeys(names, 0), []
    while True:
        t = len(out)
        ready = [(-(-(done[s] + 1) * total // weights[s]), s) for s in names if done[s] * total // weights[s] <= t]
        s = min(ready)[1]
        if done[s] >= blocks[s]:
            return out
        out.append((s, done[s]))
        done[s] += 1


def planned(spark, weights, blocks, stretch, warm):
    rows = [(s, float(w), blocks[s]) for s, w in weights.items()]
    one, picks = mixing.schedule(spark.createDataFrame(rows, "source_name string, weight double, blocks long"), stretch, warm)
    names = [x.source_name for x in one.first().s]
    got = {r.slot: (names[r.k], r.block) for r in picks.collect()}
    assert sorted(got) == list(range(len(got)))
    return [got[t] for t in range(len(got))]


def test_stretches_side_by_side_are_one_schedule(spark):
    for weights, size in (({"a": 7, "b": 2, "c": 1}, 600), ({"a": 1, "b": 1, "c": 1}, 500), ({f"s{i:02}": 1 + i * i % 17 for i in range(23)}, 60)):
        blocks = {s: size * w for s, w in weights.items()} if len(weights) < 5 else dict.fromkeys(weights, size)
        want = naive(weights, blocks)
        for stretch, warm in ((50, 0), (97, 31)):
            assert planned(spark, weights, blocks, stretch, warm) == want


def test_five_hundred_sources_stay_within_a_block(spark):
    weights = {f"s{i:03}": 1.0 + (i * 37 % 101) / 10 for i in range(500)}
    total = sum(weights.values())
    got = planned(spark, weights, dict.fromkeys(weights, 6), 250, 100)
    done = dict.fromkeys(weights, 0)
    for t, (s, _) in enumerate(got):
        done[s] += 1
        if t % 50 == 0:
            assert all(abs(done[x] - w / total * (t + 1)) < 1 + 1e-6 for x, w in weights.items())
    assert len(got) > 1000


def test_a_long_plan_is_joined_to_the_same_result(spark):
    docs = spark.createDataFrame([(i, "abc"[i * i % 3]) for i in range(400)], "doc_id long, source string")
    runs = [sorted(map(tuple, mixing.mix_sources(docs, block_docs=2, broadcast=n).collect())) for n in (10**6, 0)]
    assert runs[0] == runs[1] and len(runs[0]) == 400


def test_clashing_names_pass_through(spark):
    names = ["turn", "_share", "_s", "_w", "_i", "_hash", "_turn", "_horizon", "k", "every", "hash", "bucket", "id", "rank", "i", "total", "n", "weight", "_row", "rest", "start", "planned"]
    docs = spark.createDataFrame([(j, "ab"[j % 2], *range(len(names))) for j in range(40)], "doc_id long, source string, " + ", ".join(f"{c} long" for c in names))
    out = mixing.mix_sources(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and all(tuple(r)[2 : len(docs.columns)] == tuple(range(len(names))) for r in out.collect())
    assert mixing.mixed_order(docs).columns == docs.columns and mixing.mixed_order(docs, with_slot=True).columns == [*docs.columns, "slot"]
    assert mixing.mix_sources(docs.limit(0)).count() == 0
