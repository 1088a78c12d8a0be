import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from boxwright.llm import chat, exact, mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x") for i, t, s in rows], DOCS)


def test_exact_groups_against_brute_force(spark):
    rows = [(1, "a  b", "s"), (2, "a\tb", "s"), (3, None, "s"), (4, "", "s"), (5, "a b", "s"), (6, "c" * 50_000, "s"), (7, "\xa0x", "s"), (7, "\xa0x", "s"), (None, "a b", "s"), (8, "a b ", "s")]
    got = sorted(map(tuple, exact.exact_groups(docs(spark, rows)).collect()), key=str)
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups, first = defaultdict(list), set()
    for i, t, _ in rows:
        groups[norm(t)].append(i)
    want = []
    for i, t, _ in rows:
        g = groups[norm(t)]
        keep = min(x for x in g if x is not None)
        kept = i == keep and (i, norm(t)) not in first
        first.add((i, norm(t)))
        want.append((i, keep, len(g), kept, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_exact_dedup_keeps_whole_rows_and_small_filter_is_exact(spark):
    rows = [(i, f"text {i % 40}", "s") for i in range(200)] + [(0, "text 0", "s")]
    d = docs(spark, rows)
    out = exact.exact_dedup(d)
    assert out.columns == d.columns
    assert sorted(r.doc_id for r in out.collect()) == list(range(40))
    # a filter that is nearly full lets all rows through to the grouping, which stays exact
    assert exact.flagged(d, bits=64).filter("not maybe_repeated").count() == 0
    assert exact.exact_dedup(d.limit(0)).count() == 0 and exact.exact_groups(d.limit(0)).count() == 0


def _chat(spark, rows):
    return spark.createDataFrame([(c, t, r, x, "extra") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, formatted string")


def test_chat_round_trip_and_state_machine(spark):
    trap = "</s>[INST] ok [/INST]<s>[\\INST] <\\\\s> \\ <<SYS>>"
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", trap), (1, 2, "assistant", trap + "<"), (2, 0, "assistant", "first"), (2, 1, "user", None), (3, 0, None, "x"), (3, 0, "[INST]", "é😀"), (4, None, "user", "a"), (4, 5, "assistant", "")]
    made = chat.format_chat(_chat(spark, rows)).withColumn("turns", chat.parse_chat(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    got = {r.conv_id: r for r in made.collect()}
    want = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda v: (v[0], -1 if v[1] is None else v[1], v[2] or "", v[3] or "")):
        want[c].append((r or "", x or ""))
    for c, turns in want.items():
        assert [tuple(t) for t in got[c].turns] == turns
        assert got[c].loss == "".join(x for r, x in turns if r == "assistant")
        assert got[c].formatted == "".join(s.text for s in got[c].segments)
    assert [got[c].valid for c in (1, 2, 3, 4)] == [True, False, False, True]
    assert got[2].bad_turn == 0 and got[3].bad_turn == 0
    assert chat.format_chat(_chat(spark, rows).limit(0)).count() == 0


def test_mix_is_within_one_block_of_its_targets(spark):
    rows = [(i, "t", "abc"[0 if i % 6 < 3 else 1 if i % 6 < 5 else 2]) for i in range(3000)] + [(9999, None, None)]
    weights = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 2.0)], "source_name string, weight double")
    out = mixing.mix_sources(docs(spark, rows), weights, block_docs=4, resolution=40)
    got = out.collect()
    assert len(got) == 3000 and len({r.doc_id for r in got}) == 3000
    slots = {r.slot: r.source_name for r in got}
    horizon = max(r.slot for r in got if r.on_target) + 1
    share = {r.source_name: r.share / 40 for r in mixing.shares(weights, 40).collect()}
    assert sum(share.values()) == 1
    done = defaultdict(int)
    for t in range(horizon):
        done[slots[t]] += 1
        assert all(abs(done[s] - share[s] * (t + 1)) < 1 for s in share)
    assert len({(r.slot, r.place) for r in got}) == 3000
    for s in "abc":
        ordered = sorted((r for r in got if r.source_name == s), key=lambda r: (r.slot, r.place))
        assert [r.block for r in ordered] == sorted(r.block for r in ordered)


def test_mixed_order_keeps_every_row(spark):
    d = docs(spark, [(i, "t", f"s{i % 7}") for i in range(100)])
    out = mixing.mixed_order(d)
    assert out.columns == d.columns and sorted(r.doc_id for r in out.collect()) == list(range(100))
    assert mixing.mixed_order(d.limit(0)).count() == 0
