import re
from collections import Counter

import numpy as np
import pyarrow as pa

from boxwright.llm import classify, language, rules
from boxwright.llm.common import Texts

TEXTS = [None, "", " \n ", "a b c d e f g h i a b c d e f g h", "x | y\nx | y\n\n é$ ##\nx | y", "one two three. " * 30 + "\nEnd!", "w " * 500, "\n\na\n", "| menu |\n" * 12]


def test_base_counts_equal_brute_force():
    word = re.compile(r"[^\x20\x09-\x0D]+")
    a = rules.analyse(Texts(pa.array(TEXTS)))
    for i, t in enumerate(x or "" for x in TEXTS):
        w = word.findall(t)
        wins = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        n, covered, seen, dup = Counter(wins), set(), set(), 0
        for k, x in enumerate(wins):
            if n[x] > 1:
                covered.update(range(k, k + 8))
        for line in t.split("\n"):
            if word.search(line):
                dup += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))
        assert want == tuple(int(a[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), t


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(3)
    crf = rules.Crf(rng.normal(size=(4, 2)), rng.normal(size=(2, 2)))
    x, group = rng.normal(size=(11, 4)), np.array([0] * 5 + [1] * 1 + [4] * 5)
    got = crf.decode(x, group)
    for g in np.unique(group):
        s = x[group == g] @ crf.weights
        n = len(s)
        paths = [[(m >> k) & 1 for k in range(n)] for m in range(2**n)]
        best = max(paths, key=lambda p: sum(s[k, p[k]] for k in range(n)) + sum(crf.moves[p[k], p[k + 1]] for k in range(n - 1)))
        assert got[group == g].tolist() == best


def test_models_take_any_text(spark):
    d = spark.createDataFrame([(i, t, ("en", "fr")[i % 2], 1.0) for i, t in enumerate(TEXTS * 4)], "doc_id long, text string, lang string, score double")
    lab = spark.createDataFrame([(i, i % 3 and 1) for i in range(30)], "doc_id long, quality int")
    n = len(TEXTS) * 4
    found = language.identify(d, language.train(d)).collect()
    assert len(found) == n and all(0 <= r.score <= 1 for r in found)
    assert all((r.lang_pred == "und") == (not re.search("[a-zé]", TEXTS[r.doc_id % len(TEXTS)] or "")) for r in found)
    assert {r.lang_pred for r in language.identify(d, None).collect()} == {"und"}
    scored = classify.score_quality(d, *classify.train(d, lab)).collect()
    assert len(scored) == n and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    judged = rules.judge(d, rules.train(d, lab)).collect()
    assert len(judged) == n and not any(r.kept and r.base_failed for r in judged)
    assert rules.keep_good(d, None).columns == d.columns
