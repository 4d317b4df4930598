"""Filter kernels as tables of weights, and convolution as a join."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

CHAN = ["subject", "stimulus", "channel"]


def half_width(scale: float, fps: float) -> int:
    return int(scale * fps // 2)


def weights(name: str, scale: float, fps: float, p: float = 1.0) -> np.ndarray:
    """Weights at offsets -h..h, divided by their p-norm."""
    h = half_width(scale, fps)
    x = np.linspace(-1, 1, 2 * h + 1) if h else np.zeros(1)
    if name == "gaussian":
        w = np.exp(-((10 * x) ** 2) / 2)
    elif name == "derivative":
        w = 10 * x * np.exp(-((10 * x) ** 2) / 2)
    elif name == "average":
        w = np.exp(-((1.25 * x) ** 2) / 2)
    elif name == "turn_up":
        w = 1 / (1 + np.exp(-10 * x))
    elif name == "turn_down":
        w = 1 / (1 + np.exp(10 * x))
    elif name == "still":
        w = np.ones_like(x)
    else:
        raise ValueError(name)
    norm = (np.abs(w) ** p).sum() ** (1 / p)
    return w / norm if norm else w


def kernel_table(spark: SparkSession, bank: list[tuple[str, float]], fps: float, reach: int | None = None) -> DataFrame:
    """(filter, scale, offset, weight); weights are normed on their full width, then cut to ``reach`` frames."""
    rows = []
    for name, scale in bank:
        w = weights(name, scale, fps)
        h = len(w) // 2
        rows += [(name, float(scale), k, float(w[k + h])) for k in range(-h, h + 1) if reach is None or abs(k) <= reach]
    return spark.createDataFrame(rows, "filter string, scale double, offset int, weight double")


def _dealt(long: DataFrame, kernel: DataFrame, by: list[str], **sums) -> DataFrame:
    """Each frame dealt to the frames that it weighs in on and summed there, partly before the exchange; frames of the series alone.

    Every kernel has an offset 0, so a frame of the series is one that dealt to itself.
    """
    spread = long.join(F.broadcast(kernel)).select("*", (F.col("frame") + F.col("offset")).alias("at"))
    own = F.max(F.col("offset") == 0).alias("own")
    total = spread.groupBy(*CHAN, *by, F.col("at").alias("frame")).agg(own, *[F.sum(c).alias(n) for n, c in sums.items()])
    return total.where("own").drop("own")


def convolve(long: DataFrame, kernel: DataFrame, value: str = "value") -> DataFrame:
    """Centred convolution, zero outside the series: (subject, stimulus, channel, filter, scale, frame, value).

    Meant for kernels of tens of frames; wide ones go through ``layers``.
    """
    return _dealt(long, kernel, ["filter", "scale"], value=F.col(value) * F.col("weight"))


def local_stats(long: DataFrame, scale: float, fps: float) -> DataFrame:
    """mean, var and cumul (mean size) around each frame, by the averaging kernel."""
    v, w = F.col("value"), F.col("weight")
    own = _dealt(long, kernel_table(long.sparkSession, [("average", scale)], fps), [], mean=w * v, square=w * v * v, cumul=w * F.abs(v))
    return own.select(*CHAN, "frame", "mean", (F.col("square") - F.col("mean") * F.col("mean")).alias("var"), "cumul")


def convolve_weighted(long: DataFrame, kernel: DataFrame) -> DataFrame:
    """Convolution of known frames over the convolution of their mask; ``value`` is null where unknown."""
    v, w = F.col("value"), F.col("weight")
    both = _dealt(long, kernel, ["filter", "scale"], known=F.coalesce(v, F.lit(0.0)) * w, mass=v.isNotNull().cast("double") * w)
    return both.select(*CHAN, "filter", "scale", "frame", (F.col("known") / F.when(F.col("mass") < 0.01, 1.0).otherwise(F.col("mass"))).alias("value"))


def window_bounds(n: int, scale: float, fps: float) -> list[tuple[int, int]]:
    """Half-overlapping windows of n frames."""
    inc = max(int(scale * fps), 1)
    return [(int(i * inc / 2), min(int(i * inc / 2) + inc, n)) for i in range(max(int(2 * n / inc) - 1, 1))]


def pool_windows(long: DataFrame, lengths: DataFrame, scale: float, fps: float) -> DataFrame:
    """max, mean and var of each half-overlapping window; ``lengths``: (stimulus, n_frames), a short calendar."""
    inc = max(int(scale * fps), 1)
    count = F.greatest((F.floor(2 * F.col("n_frames") / inc) - 1).cast("int"), F.lit(1))
    bounds = lengths.select("stimulus", "n_frames", F.explode(F.sequence(F.lit(0), count - 1)).alias("window"))
    begin = F.floor(F.col("window") * inc / 2).cast("int")
    bounds = bounds.select(F.col("stimulus").alias("s"), "window", begin.alias("begin"), F.least(begin + inc, F.col("n_frames")).alias("end"))
    inside = (F.col("stimulus") == F.col("s")) & (F.col("frame") >= F.col("begin")) & (F.col("frame") < F.col("end"))
    return long.join(F.broadcast(bounds), inside).groupBy(*CHAN, "window").agg(F.max("value").alias("max"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"))


def bin_assign(value, bins):
    """The least i with value <= bins[i], else the number of bins."""
    return F.size(F.filter(bins, lambda b: b < value))


def wide_average(values: np.ndarray, scale: float, fps: float) -> np.ndarray:
    return fft_convolve(values, weights("average", scale, fps))


def fft_convolve(values: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Centred convolution along the last axis, zero outside; a kernel wider than the series is cut after its norm."""
    n, h = values.shape[-1], len(kernel) // 2
    if h >= n:
        kernel, h = kernel[h - n + 1 : h + n], n - 1
    size = 1 << math.ceil(math.log2(max(n + len(kernel) - 1, 1)))
    out = np.fft.irfft(np.fft.rfft(values, size) * np.fft.rfft(kernel, size), size)
    return out[..., h : h + n]


def fft_convolve_all(values: np.ndarray, kernels: list[np.ndarray]) -> list[np.ndarray]:
    """``fft_convolve`` with several kernels; the values are transformed once."""
    n = values.shape[-1]
    cut = [k[len(k) // 2 - n + 1 : len(k) // 2 + n] if len(k) // 2 >= n else k for k in kernels]
    size = 1 << math.ceil(math.log2(max(n + max(map(len, cut)) - 1, 1)))
    spectrum = np.fft.rfft(values, size)
    out = []
    for k in cut:
        h = len(k) // 2
        out.append(np.fft.irfft(spectrum * np.fft.rfft(k, size), size)[..., h : h + n])
    return out


def pool_last(values: np.ndarray, bounds: list[tuple[int, int]], pool=np.max) -> np.ndarray:
    """``pool`` over windows of the last axis."""
    return np.stack([pool(values[..., a:b], axis=-1) for a, b in bounds], axis=-1)
