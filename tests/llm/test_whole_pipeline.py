"""All five stages on a small table, each against a brute-force version over what its predecessor kept."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from boxwright.llm import packing, queries, rules
from boxwright.llm.common import Texts

BLANKS = re.compile("[\x20\x09-\x0d]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(i, n):
    return " ".join(f"word{(i * 37 + k * k * (i % 11 + 1)) % 997}" for k in range(n)).capitalize() + "."


def corpus():
    rows, labels = [], []
    for i in range(90):
        text, quality = "\n".join(sentence(i * 3 + k, 14) for k in range(3)), 1
        if i % 9 == 4:
            text, quality = "\n".join(f"| BUY {i} | $$$ ### !! | NOW *** |" * 3 for _ in range(5)), 0
        if i % 10 == 7:  # a copy with other blanks
            text = rows[-1][1].replace(" ", "  ")
            quality = labels[-1][1]
        if i % 10 == 3:  # a near copy
            text = rows[-2][1] + " tail"
            quality = labels[-2][1]
        rows.append((i, text, "en", "abc"[i % 7 % 3], len(text)))
        labels.append((i, quality, 0))
    return [*rows, (200, None, "en", "a", 0), (201, "too short", None, None, 9)], labels


def shingles(text):
    w = [x for x in BLANKS.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near(rows):
    sets, root = {r.doc_id: shingles(r.text) for r in rows}, {r.doc_id: r.doc_id for r in rows}

    def find(x):
        return x if root[x] == x else find(root[x])

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in ids if find(i) == i}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    rows, labels = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_every_stage_does_its_work_on_what_the_last_one_kept(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, kept = [n for n, _ in corpus_pipeline.STAGES], []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.cut(stage(spark, docs, folder))
        after = docs.collect()
        if name == names[0]:
            crf = rules.train(spark.createDataFrame(before, COLUMNS), spark.read.parquet(f"{folder}/labels.parquet"))
            a, share = rules.verdict(Texts(pa.array([r.text for r in before], pa.string())), crf)
            ok = (a["n_words"] >= 20) & (100 * a["n_repeat_words"] <= 30 * a["n_words"]) & (share >= rules.SHARE)
            assert {r.doc_id for r in after} == {r.doc_id for r, k in zip(before, ok, strict=True) if k}
            assert not {r.doc_id for r in after} & {200, 201} and len(after) < len(before) - 2
        elif name == names[1]:
            first = {}
            for r in sorted(before, key=lambda r: r.doc_id):
                first.setdefault(BLANKS.sub(" ", r.text), r.doc_id)
            assert {r.doc_id for r in after} == set(first.values()) and len(after) < len(before)
        elif name == names[2]:
            assert {r.doc_id for r in after} == near(before) and len(after) < len(before)
        elif name == names[3]:
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
            slots = defaultdict(set)
            for r in after:
                slots[r.slot].add(r.source)
            assert sorted(slots) == list(range(len(slots))) and all(len(v) == 1 for v in slots.values())
        else:
            lib = Tokenizer.from_file(queries.vocabulary_path())
            text = {r.doc_id: r.text for r in before}
            pieces = defaultdict(list)
            for r in after:
                pieces[r.doc_id].append(r)
            assert set(pieces) == set(text)
            for i, parts in pieces.items():
                ids = np.array([*lib.encode(text[i], add_special_tokens=False).ids, 0], "<u4")
                parts.sort(key=lambda r: r.piece)
                assert [r.start for r in parts] == [0, *np.cumsum([r.length for r in parts])[:-1]] and sum(r.length for r in parts) == len(ids)
                assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in parts)
            filled = defaultdict(int)
            for r in sorted(after, key=lambda r: (r.sequence_id, r.offset)):
                assert r.offset == filled[r.sequence_id]
                filled[r.sequence_id] += r.length
            assert max(filled.values()) <= 2048
        kept.append(len(after))
        assert name == names[-1] or set(docs.columns) - {"slot"} == {"doc_id", "text", "lang", "source", "n_chars"}
    whole = {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect()}
    assert whole == {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in after}


def test_empty_documents_give_no_rows(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_vector_best_fit_equals_a_loop():
    rng = np.random.default_rng(8)
    for _ in range(30):
        lengths = np.sort(rng.integers(1, 60, 40))[::-1]
        caps = np.array([64, 5, 2000.0])
        bins, want = [], []
        for n in lengths:
            item = np.array([n, 1, n * n]) / caps
            options = [(float(np.dot(packing.WEIGHTS, (left - item) ** 2)), k) for k, left in enumerate(bins) if ((left - item) >= -1e-9).all()]
            k = min(options)[1] if options and n < 64 else len(bins)
            if k == len(bins):
                bins.append(np.ones(3))
            bins[k] = bins[k] - item
            want.append(k)
        got = packing.best_fit(lengths, 64, 5, 2000.0)
        assert got.tolist() == want
