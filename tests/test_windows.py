from pyspark.sql import functions as F

from sensorweave.operators import windows
from sensorweave.plans import packets


def numbered(spark, n):
    return spark.range(1, n + 1).selectExpr("id AS rn", "CAST(id AS DOUBLE) AS v")


def test_sliding(spark):
    got = windows.sliding(numbered(spark, 8), "v", 4, "rn").orderBy("rn").collect()
    assert got[0].window == [1.0, 2.0, 3.0, 4.0] and got[-1].window == [5.0, 6.0, 7.0, 8.0]
    assert windows.sliding(numbered(spark, 3), "v", 4, "rn").count() == 0


def test_hops(spark):
    full = windows.complete_windows(windows.hop_members(numbered(spark, 13), 8, 4), 8, [], [F.min("v").alias("lo"), F.max("v").alias("hi")])
    assert sorted((r.window_end, r.lo, r.hi) for r in full.collect()) == [(8, 1.0, 8.0), (12, 5.0, 12.0)]
    gaps = windows.complete_windows(windows.hop_members(numbered(spark, 20), 3, 5), 3, [], [F.min("v").alias("lo")])
    assert sorted((r.window_end, r.lo) for r in gaps.collect()) == [(5, 3.0), (10, 8.0), (15, 13.0), (20, 18.0)]


def test_global_numbers_are_dense(spark):
    df = spark.range(1000).selectExpr("id * id % 7919 AS t").distinct()
    got = [r.rn for r in windows.with_global_row_number(df, "t", 100).orderBy("t").collect()]
    assert got == list(range(1, len(got) + 1))


def test_sampling(spark):
    assert [r.rn for r in windows.sample_every(numbered(spark, 10), 3).orderBy("rn").collect()] == [3, 6, 9]
    assert [r.rn for r in windows.sample_every(numbered(spark, 10), 3, zero_based=True).orderBy("rn").collect()] == [1, 4, 7, 10]


def test_linspace(spark):
    got = [r[0] for r in spark.range(5).select(windows.linspace_index(F.col("id"), 5, 10)).collect()]
    assert got == [0, 2, 4, 6, 9]


def test_model_windows(spark):
    df = spark.range(1, 13).selectExpr("id AS rn", "array(CAST(id AS FLOAT), CAST(-id AS FLOAT)) AS channels", "0.0 AS x", "1.0 AS y", "3.0 AS pupil_diameter")
    rows = packets.model_windows(df, 8, 2).orderBy("window_end").collect()
    assert [r.window_end for r in rows] == [8, 10, 12]
    assert rows[1].eeg == [3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0, -3.0, -4.0, -5.0, -6.0, -7.0, -8.0, -9.0, -10.0]
    ring = packets.model_windows(df, 8, 2, ring=True).orderBy("window_end").collect()
    assert ring[1].eeg[::2] == [9.0, 10.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]
