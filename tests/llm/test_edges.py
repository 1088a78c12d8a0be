"""Empty tables, very long texts, null and repeated ids, string ids and clashing columns for the other operators."""


from boxwright.llm import near, packing, queries, suffixes, tokens

LONG = "wörter und mehr " * 60_000
ROWS = [("a", LONG, 1), ("b", None, 2), (None, "", 3), ("a", LONG, 4), (None, "one two three", 5)]
CLASH = "doc_id string, text string, n long, id long, key long, h long, uid long, node long, salt long, piece string, length string, slot string, pool long, n_tokens string"


def docs(spark):
    return spark.createDataFrame([(i, t, *[k] * 7, "p", "l", "s", k, "x") for i, t, k in ROWS], CLASH)


def test_tokens_and_packing(spark):
    d, path = docs(spark), queries.vocabulary_path()
    got = tokens.count_tokens(d, path).collect()
    assert len(got) == 5 and sorted(r.n_bytes for r in got) == sorted(len((t or "").encode()) for _, t, _ in ROWS)
    out = packing.pack_documents(d, path).collect()
    assert {r.doc_id for r in out} == {"a", "b", None} and sum(r.length for r in out) == sum(r.n_tokens + 1 for r in got)
    assert tokens.count_tokens(d.limit(0), path).count() == 0 and packing.pack_documents(d.limit(0), path).count() == 0


def test_near_groups(spark):
    d = docs(spark)
    got = near.near_groups(d).collect()
    assert len(got) == 5 and [r.component_id for r in got if r.doc_id == "a"] == ["a", "a"]
    assert near.near_dedup(d).columns == d.columns and near.near_groups(d.limit(0)).count() == 0


def test_suffixes(spark):
    d = docs(spark)
    got = suffixes.suffix_dedup(d).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in got) == sorted((len((t or "").encode()), len(t.encode()) if t == LONG else 0) for _, t, _ in ROWS)
    assert suffixes.suffix_dedup(d.limit(0)).count() == 0
