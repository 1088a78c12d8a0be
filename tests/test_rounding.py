from pyspark.sql import functions as F

from boxwright.plans import coverage
from boxwright.plans.registry import r4


def test_r4_rounds_the_double_as_sql_does(spark):
    """0.59725 * 10000 is below a half in doubles, though its text ends in 5; 0.00025 * 10000 is a half."""
    import duckdb

    values = [0.59725, 0.60225, 0.59525, 0.00025, 0.5, 1.00005, -0.00025, 123.45675, *[0.2 + k * 0.008 / 32 for k in range(2000)]]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(r4(F.col("v")).alias("x")).collect()]
    want = [r[0] for r in duckdb.connect().execute("SELECT round(v, 4) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [values]).fetchall()]
    assert got == want and 0.5972 in got


def test_audio_of_half_a_frame_counts_as_one_more(spark, tmp_path):
    spark.createDataFrame([(239, 2794.0), (299, 2790.0), (240, 2794.0)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r.stream: r.expected_mux_frames for r in coverage.mux_expectations(spark, str(tmp_path)).collect()}
    assert got == {239: 699, 299: 698, 240: 1000 + 240 * 37}
