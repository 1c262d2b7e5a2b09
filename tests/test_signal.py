import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorweave.functions import scalar, signal


def one(spark, values, column):
    return spark.createDataFrame([(values,)], "w array<double>").select(column.alias("v")).first().v


def test_fft_sizes():
    assert [signal.fft_size(n) for n in (2, 3, 32, 33, 64, 129, 256, 300, 4096)] == [2, 2, 16, 32, 32, 128, 128, 256, 2048]


def test_published_bins():
    assert signal.band_bins(16, 128.0) == [(0, 1), (1, 1), (1, 2), (2, 4), (4, 8)]
    assert signal.band_bins(16, 500.0) == [(0, 0), (0, 0), (0, 0), (0, 1), (1, 3)]
    assert signal.band_bins(128, 256.0) == [(0, 2), (2, 4), (4, 7), (7, 15), (15, 50)]


def test_published_features():
    f = signal.numpy_features(np.sin(0.1 * np.arange(256))[None, :], 256.0)[0]
    assert f[:2] == pytest.approx([0.151027405, 0.848906093], abs=1e-8)
    assert f[5:] == pytest.approx([-4.265442223, -2.538954962, -12.000043362, -17.028347135, -21.376877648, 0.701266927], abs=1e-6)
    zeros = signal.numpy_features(np.zeros((1, 64)), 256.0)[0]
    assert zeros[:5].tolist() == [0.0] * 5
    assert zeros[5:10] == pytest.approx([math.log(1e-30)] * 5)
    tone = signal.numpy_features(np.sin(2 * np.pi * 10 * np.arange(256) / 256)[None, :], 256.0)[0]
    assert tone[2] == pytest.approx(0.999989693, abs=1e-8)


def test_sql_form_equals_numpy(spark):
    rng = np.random.default_rng(0)
    w = rng.normal(size=64)
    df = spark.createDataFrame([(w.tolist(),)], "w array<double>").withColumn("s", signal.newest(F.col("w"), 32)).withColumn("p", signal.power_spectrum(F.col("s"), 32))
    assert df.first().p == pytest.approx(signal.numpy_spectrum(w[None, :], 32)[0].tolist(), abs=1e-12)


def test_short_windows_are_padded_on_the_left(spark):
    assert one(spark, [1.0, 2.0], signal.newest(F.col("w"), 4)) == [0.0, 0.0, 1.0, 2.0]


def test_arrow_features_take_mixed_lengths(spark):
    df = spark.createDataFrame([([1.0] * 8,), ([0.5] * 16,), (None,)], "w array<double>").select(signal.features_arrow(256.0)("w").alias("f"))
    assert [len(r.f) if r.f else None for r in df.collect()] == [11, 11, None]


@pytest.mark.parametrize(("a", "b", "want"), [([1.0, 2.0], [1.0, 2.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 2.0], [-1.0, -2.0], -1.0), ([0.0, 0.0], [1.0, 1.0], 0.0)])
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    assert df.select(signal.cosine_similarity(F.col("a"), F.col("b")).alias("c")).first().c == pytest.approx(want)


def test_cosine_of_different_lengths_raises(spark):
    df = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="differ in length"):
        df.select(signal.cosine_similarity(F.col("a"), F.col("b"))).collect()


def test_scalars(spark):
    rows = [(0,), (1,), (2,), (3,), (1000,), (2**53 - 1,), (2**63 - 1,)]
    df = spark.createDataFrame(rows, "n long")
    assert [r[0] for r in df.select(scalar.log2_bucket(F.col("n"))).collect()] == [0, 0, 1, 1, 9, 52, 62]
    x = spark.createDataFrame([(i,) for i in range(4)], "n long").select(scalar.xorshift(F.col("n"))).collect()
    assert [r[0] for r in x] == [1082269761, 1082269761, 2164539522, 3246809283]
    g = spark.createDataFrame([(i,) for i in (0, 1, 2, 1000)], "n long").select(scalar.pseudo_gaussian(F.col("n"))).collect()
    assert [r[0] for r in g] == pytest.approx([6.864268825, 6.864268825, 6.762535926, 5.770870349], abs=1e-8)
    s = spark.createDataFrame([(0.0,), (10.0,), (-10.0,)], "x double").select(scalar.sigmoid(F.col("x")).alias("s")).collect()
    assert s[0].s == 0.5 and s[1].s > 0.99 and s[2].s < 0.01
