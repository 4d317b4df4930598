"""Hand-worked examples of resampling, gap filling, pooling and bins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionmill import schema
from motionmill.functions import kernels
from motionmill.operators import frames as fr, motion

FRAMES = "subject long, stimulus int, frame int, values array<double>"
LONG = "subject long, stimulus int, channel string, frame int, value double"


def filled(spark, columns, **how):
    rows = [(1, 1, i, None if all(v is None for v in vs) else list(vs)) for i, vs in enumerate(zip(*columns))]
    out = fr.fill_gaps(spark.createDataFrame(rows, FRAMES), **how).orderBy("frame").collect()
    return [[r["values"][c] for r in out] if out[0]["values"] else None for c in range(len(columns))]


@pytest.mark.parametrize(
    "columns, expected",
    [
        ([[None, 2.0, None, None, 8.0, None]], [[2, 2, 5, 8, 8, 8]]),
        ([[1.0, 2.0, 3.0], [4.0, None, 6.0]], [[1, 3, 3], [4, 6, 6]]),
    ],
)
def test_fill_gaps(spark, columns, expected):
    assert filled(spark, columns) == expected


def test_fill_gaps_linear(spark):
    assert filled(spark, [[0.0, None, 4.0]], mode="linear") == [[0, 2, 4]]


def test_series_without_a_frame_becomes_zero(spark):
    rows = [(1, 1, i, [None, None]) for i in range(3)]
    out = fr.fill_gaps(spark.createDataFrame(rows, FRAMES)).collect()
    assert [r["values"] for r in out] == [[0.0, 0.0]] * 3


def test_resample_takes_the_first_sample_of_a_frame(spark):
    rows = [(1, 1, 0, 0.0, 10.0), (1, 1, 1, 0.01, 11.0), (1, 1, 2, 0.034, 12.0), (1, 1, 3, 0.1, 13.0)]
    samples = spark.createDataFrame(rows, "subject long, stimulus int, sample_idx long, t double, c1 double")
    calendar = spark.createDataFrame([(1, 4)], "stimulus int, n_frames int")
    out = fr.resample_frames(samples, ["c1"], calendar, 30).orderBy("frame").collect()
    assert [r["values"] for r in out] == [[10.0], [12.0], None, [13.0]]


def test_n_frames():
    assert [schema.n_frames(s) for s in (30.6, 66.8, 69.0)] == [920, 2005, 2072]


def test_pool_windows(spark):
    long = spark.createDataFrame([(1, 1, "c", i, float(i)) for i in range(10)], LONG)
    calendar = spark.createDataFrame([(1, 10)], "stimulus int, n_frames int")
    out = kernels.pool_windows(long, calendar, 4.0, 1.0).orderBy("window").collect()
    assert [r["max"] for r in out] == [3, 5, 7, 9]


def test_bin_assign(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (2.5,), (9.0,)], "v double")
    out = df.select(kernels.bin_assign(F.col("v"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).alias("b")).collect()
    assert [r["b"] for r in out] == [0, 0, 2, 3]


def test_averaging_kernel():
    assert np.allclose(kernels.weights("average", 2.0, 1.0), [0.238994, 0.522011, 0.238994], atol=1e-6)


@pytest.mark.parametrize("name", ["gaussian", "derivative", "average", "turn_up", "turn_down", "still"])
def test_kernels_have_unit_norm(name):
    assert np.isclose(np.abs(kernels.weights(name, 12.0, 1.0)).sum(), 1)


@pytest.mark.parametrize("n, scale", [(5, 40.0), (50, 8.0), (1, 4.0), (64, 200.0)])
def test_fft_convolution_equals_the_direct_sum(n, scale):
    x, w = np.random.default_rng(0).normal(size=n), kernels.weights("derivative", scale, 1.0)
    h = len(w) // 2
    direct = [sum(x[t - k] * w[k + h] for k in range(-h, h + 1) if 0 <= t - k < n) for t in range(n)]
    assert np.allclose(kernels.fft_convolve(x, w), direct)


def test_convolve_join_equals_fft(spark):
    x = np.random.default_rng(1).normal(size=30)
    long = spark.createDataFrame([(1, 1, "c", i, float(v)) for i, v in enumerate(x)], LONG)
    out = kernels.convolve(long, kernels.kernel_table(spark, [("derivative", 8.0)], 1.0)).orderBy("frame").collect()
    assert np.allclose([r["value"] for r in out], kernels.fft_convolve(x, kernels.weights("derivative", 8.0, 1.0)))


def test_local_maxima(spark):
    long = spark.createDataFrame([(1, 1, "c", i, float(v)) for i, v in enumerate([1, 3, 3, 2, 5])], LONG)
    assert sorted(r["frame"] for r in motion.local_maxima(long, 0.5).collect()) == [2, 4]


def test_partition_count_and_row_order_do_not_matter(spark):
    rows = [(s, 1, i, [float(i % 7)] if i % 3 else None) for s in range(5) for i in range(40)]
    a = fr.fill_gaps(spark.createDataFrame(rows, FRAMES).repartition(1)).collect()
    b = fr.fill_gaps(spark.createDataFrame(rows[::-1], FRAMES).repartition(7)).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_correlation_of_a_series_of_one_value_is_0(spark):
    rows = [(1, 1, c, t, v) for t in range(4) for c, v in (("a", float(t)), ("b", 5.0), ("c", -2.0 * t))]
    found = {(r["c1"], r["c2"]): r["value"] for r in motion.channel_correlation(spark.createDataFrame(rows, LONG)).collect()}
    assert found[("a", "b")] == found[("b", "a")] == found[("b", "c")] == 0
    assert np.isclose(found[("a", "c")], -1) and found[("b", "b")] == 1


def test_motor_behaviors_of_a_series_of_one_value(spark):
    rows = [(1, 1, c, t, v) for t in range(8) for c, v in (("a", 1.0 + t), ("b", 5.0))]
    found = {r["feature"]: r["value"] for r in motion.motor_behaviors(spark.createDataFrame(rows, LONG), 1.0, 2).collect()}
    assert found["corr:a:b"] == 0 and found["lag:b"] is None and found["asymmetry:b"] == 5
