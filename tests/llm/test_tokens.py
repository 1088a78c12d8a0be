import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from boxwright.llm import packing, tokens
from boxwright.llm.common import Texts

P = pytest.importorskip("public_tokenizers")
PATH = str(P.path("byte_bpe_50k.json"))
TEXTS = ["", " ", "  ", "\n", "a", " a", "  a", "a  ", "a \n b", "it's they're 's 's' 'll'sabc x''s '' 're", " 's \n's", "é'très ça  Éa", "12 345a6 7", "$$$ !! a!!b ###", "<|endoftext|> x", "日本語 text", "👍 ok", "x y\u0085z\x1c w", "“quoted” — dash… €5", "ñ" * 3000, "\t\t a\t b \r\n c  ", None, "''''s", "a'", "'r", "'re", "l'll'l", "he's've'd'm 't"]


def test_counts_and_ids_equal_the_library():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(PATH)
    v = tokens.vocabulary(PATH)
    assert v.shortcut and v.proven > 40_000
    rng = np.random.default_rng(5)
    alphabet = list("ab'sterlvmd  \n\t.,!#09éñ —")
    texts = TEXTS + ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(4000)]
    counts, ids = v.encode(Texts(pa.array(texts)), True)
    want = [e.ids for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for t, got, n, w in zip(texts, ids, counts, want, strict=True):
        assert got.tolist() == w and n == len(w), repr(t)


def test_class_table_is_what_the_library_does():
    v = tokens.vocabulary(PATH)
    for lo, hi in tokens.CLASSES:
        for c in range(lo, hi):
            if chr(c) == "'":
                continue
            for text in (f"a{chr(c)}b", f"1{chr(c)}2", f".{chr(c)}.", f" {chr(c)} a"):
                t = Texts(pa.array([text]))
                start, _ = tokens.pretoken_starts(*tokens._characters(t), t)
                want = [s for _, (s, _) in v.lib.pre_tokenizer.pre_tokenize_str(text)]
                assert np.flatnonzero(start).tolist() == want, (hex(c), text)


def test_other_vocabularies(spark):
    d = spark.createDataFrame([(1, "Hello there"), (2, None)], "doc_id long, text string")
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(d, str(P.path(name))).collect()}
        assert got[1] == 2 and got[2] == 0


def test_packing_is_gapless_and_close_to_the_bound(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(PATH)
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["word"] * int(rng.integers(0, 120)))) for i in range(400)] + [(400, None), (401, "a b " * 400), (401, "a b " * 400), (None, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_documents(d, PATH, 128, pool=100).collect()
    seq = defaultdict(list)
    for r in got:
        seq[r.sequence_id].append(r)
    for s in seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 128
    ids = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    assert sum(r.length for r in got) == sum(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.asarray(part, "<u4").tobytes()) == r.ids_crc32
        assert r.length == 128 or r.piece == 0
    assert len(seq) <= 1.05 * sum(r.length for r in got) / 128 + 4
    assert packing.pack_documents(d.limit(0), PATH, 128).count() == 0


def test_every_capacity_holds():
    lengths = np.sort(np.random.default_rng(1).integers(1, 100, 500))[::-1]
    where = packing.best_fit(lengths, 100, 3, 100**2 * 0.6 + 1)
    for b in np.unique(where):
        mine = lengths[where == b]
        assert len(mine) == 1 or (mine.sum() <= 100 and len(mine) <= 3 and (mine.astype(float) ** 2).sum() <= 6001)
