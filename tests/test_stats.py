import pytest
from pyspark.sql import functions as F

from sensorweave.operators import stats


def test_welford(spark):
    df = spark.createDataFrame([(float(x),) for x in (2, 4, 4, 4, 5, 5, 7, 9)], "x double")
    row = df.agg(*stats.welford(F.col("x"))).first()
    assert (row["count"], row.mean) == (8, 5.0)
    assert row.variance == pytest.approx(32 / 7)
    assert tuple(df.where("x = 9").agg(*stats.welford(F.col("x"))).first()) == (1, 9.0, 0.0, 0.0)
    assert tuple(df.where("x > 9").agg(*stats.welford(F.col("x"))).first()) == (0, 0.0, 0.0, 0.0)
    far = spark.range(100_000).select((1e9 + F.col("id") % 100).alias("x")).agg(*stats.welford(F.col("x"))).first()
    assert far.mean == pytest.approx(1e9 + 49.5)
    assert far.std_dev == pytest.approx(28.866214379, abs=1e-6)


def test_histogram(spark):
    df = spark.range(1000).selectExpr("CASE WHEN id < 900 THEN 1000 WHEN id < 999 THEN 1000000 ELSE 1000000000 END AS ns")
    hist = stats.log2_histogram(df, "ns")
    assert {r.bucket: r.n for r in hist.collect()} == {9: 900, 19: 99, 29: 1}
    got = {r.p: r.ns for r in stats.histogram_percentiles(hist, [50.0, 90.0, 99.0, 99.9]).collect()}
    assert got == {50.0: 512, 90.0: 512, 99.0: 524288, 99.9: 524288}
    assert tuple(df.agg(*stats.latency_summary(F.col("ns"))).first()) == (1000, 1_099_900, 1000, 10**9)
    assert tuple(df.where("ns < 0").agg(*stats.latency_summary(F.col("ns"))).first()) == (0, 0, 0, 0)


def test_saturating_sum(spark):
    df = spark.createDataFrame([(2**63 - 1,), (2**63 - 1,)], "ns long")
    assert df.agg(*stats.latency_summary(F.col("ns"))).first().mean_ns == (2**63 - 1) // 2


def test_jitter(spark):
    times, t = [], 0
    for i in range(1000):
        t += 10**6 + (i % 10) * 10**5
        times.append((t,))
    row = stats.jitter(spark.createDataFrame(times, "t long"), "t").first()
    assert row.n_intervals == 999
    assert row.mean_interval == pytest.approx(1_450_450.4504, abs=1e-3)
    assert row.jitter_std_dev == pytest.approx(287_162.3613, abs=1e-3)


def test_rates(spark):
    row = spark.range(1).select(
        stats.frames_per_second(F.lit(20_000).cast("long"), F.lit(109).cast("long")).alias("fps"),
        stats.real_time_factor(F.lit(20_000), F.lit(500.0), F.lit(109)).alias("rtf"),
        stats.loss_fraction(F.lit(1000), F.lit(50), F.lit(10)).alias("loss"),
        stats.frames_per_second(F.lit(5).cast("long"), F.lit(0).cast("long")).alias("none"),
    ).first()
    assert (row.fps, round(row.rtf, 1), row.loss, row.none) == (183_486, 367.0, 0.06, 0)


def test_picks_need_enough_rows(spark):
    few = stats.picked_percentiles(spark.range(20).selectExpr("id AS v"), "v").first()
    many = stats.picked_percentiles(spark.range(200).selectExpr("id AS v"), "v").first()
    assert (few.p95, few.p99, many.p95, many.p99, many.median) == (0.0, 0.0, 190.0, 198.0, 99.5)
