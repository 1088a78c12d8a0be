import random

import pytest

from boxwright.llm import pieces
from boxwright.llm.queries import vocabulary_path

HARD = [
    "", " ", "  ", "a", " a  b ", "\x00a<s></s><unk> ▁x ⁇", "﻿​<0x0A>", "日本語テキスト 한국어 text", "😀👩‍👩‍👧 é é", "a" * 5000,
    "ab" * 3000 + " " * 300 + "x", "\n\n\r\n\t", "▁▁▁▁", " " * 100, "1234567890 3.14", "the the theatre" * 200, "�￾", "中" * 200 + "a" * 70, "…—“”‘’", "ſſ" * 50 + "qu" * 100, None,
]


@pytest.fixture(scope="module")
def path():
    return vocabulary_path("piece_bpe_32k.model")


def texts(seed):
    rng = random.Random(seed)
    letters = "abcdeé ▁\n中日😀12.,'<>st"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 150))) for _ in range(1500)]


def test_ids_and_texts_are_the_librarys(spark, path):
    lib = pieces.pieces(path).lib
    rows = [(i % 1000, t, "x", "y") for i, t in enumerate([*HARD, *texts(1), *HARD])]
    out = pieces.round_trip(spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string"), path)
    got = sorted((r.doc_id, r.ids, r.decoded, r.checked) for r in out.collect())
    want = []
    for i, t, _, _ in rows:
        ids = lib.encode(t or "", add_eos=True)
        want.append((i, ids, lib.decode(ids), True))
    assert got == sorted(want)
    again = pieces.decode(out.select("doc_id", "ids"), path)
    assert sorted(tuple(r) for r in again.collect()) == sorted((i, d) for i, _, d, _ in want)


def test_memory_starts_afresh(path, monkeypatch):
    import pyarrow as pa

    from boxwright.llm.common import Texts

    monkeypatch.setattr(pieces, "MEMORY", 50)
    monkeypatch.setattr(pieces, "SHORT", 8)  # most units by the heap
    model = pieces.Pieces(path)
    for part in (texts(2)[:300], texts(3)[:300], HARD):
        ids, ends, good = model.encode(Texts(pa.array(part)))
        assert good.all()
        assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)] == [model.lib.encode(t or "", add_eos=True) for t in part]


def test_a_unit_that_differs_takes_the_librarys_ids(path):
    import pyarrow as pa

    from boxwright.llm.common import Texts

    model = pieces.Pieces(path)
    model.rank = model.rank.max() - model.rank  # a wrong order of merges
    ids, ends, good = model.encode(Texts(pa.array(["theatre of the world", "a"])))
    assert not good[0] and good[1]
    assert ids[: ends[0]].tolist() == model.lib.encode("theatre of the world", add_eos=True)


def test_other_kinds_and_empty_tables(spark, path):
    with pytest.raises(Exception):
        pieces.Pieces(vocabulary_path("byte_bpe_50k.json"))
    assert pieces.round_trip(spark.createDataFrame([], "doc_id string, text string"), path).collect() == []
    ids = spark.createDataFrame([(1, None), (2, [])], "doc_id int, ids array<long>")
    assert sorted(tuple(r) for r in pieces.decode(ids, path).collect()) == [(1, ""), (2, "")]
