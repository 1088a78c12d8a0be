from pyspark.sql import functions as F

import corpus_pipeline
from boxwright.llm import packing


def test_the_mix_decides_what_is_packed_together(spark, monkeypatch):
    run = packing.pack_documents
    monkeypatch.setattr(packing, "pack_documents", lambda d, path: run(d, path, 64, pool=60))
    rows = [(i, "word " * (1 + i * 7 % 40), "ab"[i % 3 == 0]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    stages = dict(corpus_pipeline.STAGES)
    mixed = stages["mixing"](spark, docs, "").cache()
    slot = {r.doc_id: r.slot for r in mixed.collect()}
    got = stages["packing"](spark, mixed, "").collect()
    assert {r.doc_id for r in got} == set(slot) and "slot" not in got[0]
    for odd in (0, 1):  # the two rounds of pools
        pools = {}
        for r in got:
            if (r.sequence_id >> 32) % 2 == odd:
                pools.setdefault(r.sequence_id >> 32, []).append(slot[r.doc_id])
        order = [pools[p] for p in sorted(pools)]
        assert len(order) > 1 and all(max(a) <= min(b) for a, b in zip(order, order[1:]))
    fills = {}
    for r in got:
        fills.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in fills.values():
        v.sort()
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:])) and sum(n for _, n in v) <= 64
    left_out = stages["packing"](spark, docs, "").collect()
    other = stages["packing"](spark, mixed.withColumn("slot", F.lit(max(slot.values())) - F.col("slot")), "").collect()
    assert sorted(map(tuple, left_out)) != sorted(map(tuple, got)) != sorted(map(tuple, other))
