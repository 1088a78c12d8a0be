from boxwright.llm import exact

CLASH = "doc_id long, text string, keep_id string, text_sha256 string, maybe_repeated int, sha int, id int, _row string, n string, salt int, _sha string, range int"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "k", "s", 1, 2, 3, "r", "n", 4, "x", 5) for i, t in rows], CLASH)


def test_ranges_change_nothing(spark):
    d = clashing(spark, [(i, f"text {i % 70}") for i in range(300)])
    want = sorted(map(tuple, exact.exact_groups(d).collect()))
    for bits, ranges in ((64, 1), (64, 3), (4096, 5)):
        assert sorted(map(tuple, exact.exact_groups(d, bits=bits, ranges=ranges).collect())) == want
        assert sorted(r.doc_id for r in exact.exact_dedup(d, bits=bits, ranges=ranges).collect()) == list(range(70))


def test_the_filter_lets_unique_rows_pass(spark):
    d = spark.createDataFrame([(i, f"text {min(i, 900)}") for i in range(1000)], "doc_id long, text string")
    flagged = exact.flagged(d).filter("maybe_repeated").count()
    assert 100 <= flagged <= 105


def test_the_plan_bounds_each_filter():
    for rows in (0, 1, 10_000, 4_194_304, 4_194_305, 10**8, 10**12):
        bits, ranges = exact._plan(rows)
        assert bits & (bits - 1) == 0 and bits <= exact.RANGE_BITS and ranges <= exact.RANGES
        assert rows > 250_000_000 or bits * ranges >= rows * exact.BITS_PER_ROW


def test_clashing_names_and_string_ids(spark):
    d = clashing(spark, [(1, "a"), (2, "a"), (3, "b")])
    out = exact.exact_dedup(d)
    assert out.columns == d.columns and sorted(tuple(r)[:5] for r in out.collect()) == [(1, "a", "k", "s", 1), (3, "b", "k", "s", 1)]
    named = d.selectExpr("concat('d', doc_id) as doc_id", "text")
    assert sorted((r.doc_id, r.keep_id) for r in exact.exact_groups(named).collect()) == [("d1", "d1"), ("d2", "d1"), ("d3", "d3")]


def _rows(spark):
    texts = [f"text  {i % 40}" for i in range(200)] + [f"text {i}" for i in range(300)] + [None, "", " ", "text 0", "text 0"]
    return spark.createDataFrame([(i if i < 503 else 0, t, "x", i) for i, t in enumerate(texts)] + [(None, "text 7", "x", 0), (None, "alone", "x", 0)], "doc_id long, text string, sha string, id long")


def test_dedup_reads_documents_twice_whatever_the_ranges(spark, tmp_path):
    """Scans of the documents: one for the digests, and those of the plan that is given back."""
    import re

    path = f"{tmp_path}/docs"
    _rows(spark).write.parquet(path)
    docs = spark.read.parquet(path)
    want = {}
    for i, t in {(r.doc_id, r.text) for r in docs.collect()}:
        key = re.sub("[\x20\x09-\x0d]+", " ", t or "")
        want[key] = min(want.get(key, (True, 0)), (i is None, i or 0))
    ids = sorted((n, i) for n, i in want.values())
    for ranges in (1, 4, 64):
        out = exact.exact_dedup(docs, ranges=ranges)
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == ids
        twins = exact.exact_dedup(docs.filter("id < 503"), ranges=ranges)  # no rows alike in text and id
        plan = twins._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(rf"FileScan[^\n]*{re.escape(path)}", plan)) == 1


def test_many_verdicts_are_a_filter_first(spark, monkeypatch):
    docs = _rows(spark)
    few = sorted(str(r.doc_id) for r in exact.exact_dedup(docs).collect())
    monkeypatch.setattr(exact, "VERDICTS", 0)
    for ranges in (1, 4):
        assert sorted(str(r.doc_id) for r in exact.exact_dedup(docs, ranges=ranges).collect()) == few
