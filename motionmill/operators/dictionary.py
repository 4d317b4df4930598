"""Wavelets, scale-space dictionaries and patterns of single series; numpy inside each group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from motionmill.functions.kernels import fft_convolve, fft_convolve_all, half_width, weights
from motionmill.operators.layers import cube_extractor, found_extractor, series_extractor

R3, R2 = np.sqrt(3.0), np.sqrt(2.0)
#: Fixed value: the low-pass filter of four taps; the high-pass one is it reversed with alternating signs.
LOW = np.array([1 + R3, 3 + R3, 3 - R3, 1 - R3]) / (4 * R2)
HIGH = LOW[::-1] * np.array([-1, 1, -1, 1])


def shrink(x: Column, t: float, soft: bool = True) -> Column:
    """Soft: towards 0 by t; hard: 0 up to t."""
    if soft:
        return x * F.greatest(1 - t / F.greatest(F.abs(x), F.lit(1e-7)), F.lit(0.0))
    return F.when(F.abs(x) > t, x).otherwise(0.0)


def shrink_array(x: np.ndarray, t: float, soft: bool = True) -> np.ndarray:
    return x * np.maximum(1 - t / np.maximum(np.abs(x), 1e-7), 0) if soft else x * (np.abs(x) > t)


def odd_reflect(x: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """x, along its last axis, in the middle of ``size`` places, continued on both sides by odd reflection about its end values; and where it begins."""
    n = x.shape[-1]
    begin = (size - n) // 2
    if n == 1:
        return np.repeat(x, size, axis=-1), begin
    out = x
    while out.shape[-1] < 3 * size:
        out = np.concatenate((2 * out[..., :1] - out[..., :0:-1], out, 2 * out[..., -1:] - out[..., -2::-1]), axis=-1)
    middle = (out.shape[-1] - n) // 2
    return out[..., middle - begin : middle - begin + size], begin


def _analyse(a: np.ndarray, taps: np.ndarray) -> np.ndarray:
    n = a.shape[-1]
    return sum(t * a[..., (2 * np.arange(n // 2) + k) % n] for k, t in enumerate(taps))


def _padded(n: int) -> int:
    return 1 << max(int(np.ceil(np.log2(max(n, 2)))), 1)


def wavelet(x: np.ndarray) -> list[np.ndarray]:
    """Details from fine to coarse, then the last mean, of series padded to a power of two; periodic, hence invertible."""
    a, _ = odd_reflect(x, _padded(x.shape[-1]))
    out = []
    while a.shape[-1] > 1:
        out.append(_analyse(a, HIGH))
        a = _analyse(a, LOW)
    return [*out, a]


def inverse_wavelet(levels: list[np.ndarray], n: int) -> np.ndarray:
    a = levels[-1]
    for d in reversed(levels[:-1]):
        half = d.shape[-1]
        up = np.zeros((*d.shape[:-1], 2 * half))
        for k in range(4):
            up[..., (2 * np.arange(half) + k) % (2 * half)] += LOW[k] * a + HIGH[k] * d
        a = up
    begin = (a.shape[-1] - n) // 2
    return a[..., begin : begin + n]


def wavelet_transform(frames: DataFrame, channels: list[str]) -> DataFrame:
    """(.., channel, level, place, coef); the last level is the mean.

    A missing value is missing in every coefficient whose taps reach it, through reflection too.
    """

    def extract(cube: np.ndarray) -> Iterator[tuple]:
        for level, d in enumerate(wavelet(cube)):
            yield level, np.arange(d.shape[-1]), d

    return cube_extractor(frames, channels, extract, "level int, place int, coef double").withColumn("coef", F.nanvl("coef", F.lit(None).cast("double")))


def wavelet_round_trip(frames: DataFrame, channels: list[str], t: float = 0.0, soft: bool = True) -> DataFrame:
    """The series rebuilt from its coefficients, those of the details shrunk by ``t``."""

    def extract(m: np.ndarray) -> Iterator[tuple]:
        for c, row in zip(channels, m):
            levels = wavelet(row)
            kept = [shrink_array(d, t, soft) if t else d for d in levels[:-1]] + levels[-1:]
            yield c, np.arange(len(row)), inverse_wavelet(kept, len(row))

    return series_extractor(frames, extract, "channel string, frame int, value double")


#: Series that are inpainted together.
FILLED_AT_ONCE = 256


def inpaint(x: np.ndarray, t: float, rounds: int = 25, tol: float = 1e-3) -> np.ndarray:
    """Missing places of series along the last axis filled by turns of shrinking wavelet coefficients and restoring what is known.

    Each series stops by itself, once it moves by no more than ``tol`` of its size.
    """
    rows = x.reshape(-1, x.shape[-1])
    known = ~np.isnan(rows)
    out = np.where(known, rows, 0.0)
    live = np.arange(len(rows))
    for _ in range(rounds):
        if not live.size:
            break
        old = out[live]
        levels = wavelet(old)
        new = inverse_wavelet([shrink_array(d, t) for d in levels[:-1]] + levels[-1:], rows.shape[1])
        out[live] = new = np.where(known[live], rows[live], new)
        live = live[np.linalg.norm(new - old, axis=1) > tol * np.maximum(np.linalg.norm(old, axis=1), 1e-12)]
    return out.reshape(x.shape)


def wavelet_inpaint(frames: DataFrame, channels: list[str], t: float) -> DataFrame:
    """Frames with null values come back filled."""

    def extract(cube: np.ndarray) -> Iterator[tuple]:
        yield np.arange(cube.shape[2]), inpaint(cube, t)

    return cube_extractor(frames, channels, extract, "frame int, value double", FILLED_AT_ONCE)


def time_frequency(coefs: DataFrame) -> DataFrame:
    """(.., level, frame, coef): each detail coefficient held over the frames of the padded series that it stands for."""
    width = F.pow(F.lit(2), F.col("level") + 1).cast("int")
    place = F.explode(F.sequence(F.col("place") * width, (F.col("place") + 1) * width - 1))
    top = coefs.groupBy("subject", "stimulus", "channel").agg(F.max("level").alias("top"))
    return coefs.join(top, ["subject", "stimulus", "channel"]).where("level < top").select("subject", "stimulus", "channel", "level", place.alias("frame"), "coef")


def scale_space(x: np.ndarray, atoms: list[str], scales: list[float], fps: float) -> dict[str, np.ndarray]:
    """For each atom, correlation of series along the last axis with its unit-norm kernel: (scales, .., frames)."""
    return {a: np.stack(fft_convolve_all(x, [weights(a, s, fps, p=2.0)[::-1] for s in scales])) for a in atoms}


#: Weights of known frames that add up to less than this don't divide.
LEAST_WEIGHT = 0.01


def responses(x: np.ndarray, kernels: list[np.ndarray], mode: str = "same") -> list[np.ndarray]:
    """Convolutions of series along the last axis with each kernel.

    ``same``: as they are. ``weight`` and ``receptive`` pass over missing places: the sum over known ones is divided by
    their weights' sum, or by how many there are within the kernel; where that is below ``LEAST_WEIGHT``, by nothing.
    """
    if mode == "same":
        return fft_convolve_all(x, kernels)
    if mode not in ("weight", "receptive"):
        raise ValueError(mode)
    known = ~np.isnan(x)
    over = kernels if mode == "weight" else [np.ones(len(k)) for k in kernels]
    parts = zip(fft_convolve_all(np.where(known, x, 0.0), kernels), fft_convolve_all(known.astype(float), over))
    return [v / np.where(w < LEAST_WEIGHT, 1.0, w) for v, w in parts]


def dictionary_transform(frames: DataFrame, channels: list[str], atoms: list[str], scales: list[float], fps: float, mode: str = "same") -> DataFrame:
    """(.., channel, atom, scale_idx, scale, frame, value); ``mode`` as for ``responses``."""

    def extract(cube: np.ndarray) -> Iterator[tuple]:
        for atom in atoms:
            for k, out in enumerate(responses(cube, [weights(atom, s, fps, p=2.0)[::-1] for s in scales], mode)):
                yield atom, k, float(scales[k]), np.arange(cube.shape[2]), out

    return cube_extractor(frames, channels, extract, "atom string, scale_idx int, scale double, frame int, value double")


def maxima(table: np.ndarray, thres: float, full: bool = True) -> np.ndarray:
    """Mask of two-dimensional maxima of the size of ``table`` over its last axes, scale and frame, at least ``thres`` of the largest.

    Above the one before and at least the one after, in time, in scale and on the main diagonal; on the other diagonal
    above the lower left and at least the upper right. Sizes are compared to nine decimals.
    """
    a = np.abs(table).round(9)
    scales, n = a.shape[-2:]
    big = np.pad(a, [(0, 0)] * (a.ndim - 2) + [(1, 1), (1, 1)], constant_values=-np.inf)
    at = lambda ds, dt: big[..., 1 + ds : 1 + ds + scales, 1 + dt : 1 + dt + n]
    ok = (a > at(0, -1)) & (a >= at(0, 1)) & (a > at(-1, 0)) & (a >= at(1, 0))
    if full:
        ok &= (a > at(-1, -1)) & (a >= at(1, 1)) & (a > at(1, -1)) & (a >= at(-1, 1))
    return ok & (a >= thres * a.max(axis=(-2, -1), keepdims=True, initial=0)) & (a > 0)


def separate(mask: np.ndarray, table: np.ndarray, scales: list[float], fps: float) -> np.ndarray:
    """In order of scale, then frame, a maximum nearer than its scale to the last run of maxima, of any scale, joins the run; each run keeps its largest, the first of equals, and lies where it began."""
    kept = np.zeros_like(mask)
    begun, best = None, None
    for s, t in np.argwhere(mask).tolist():
        if begun is not None and abs(t - begun) < fps * scales[s]:
            if abs(table[s, t]) > abs(table[best]):
                kept[best] = False
                best = (s, t)
                kept[best] = True
            continue
        begun, best = t, (s, t)
        kept[best] = True
    return kept


def _tables(cube: np.ndarray, atom: str, scales: list[float], fps: float, mode: str = "same") -> np.ndarray:
    """(series, channels, scales, frames)."""
    return np.stack(responses(cube, [weights(atom, s, fps, p=2.0)[::-1] for s in scales], mode), axis=2)


def scale_space_maxima(frames: DataFrame, channels: list[str], atom: str, scales: list[float], fps: float, thres: float, apart: bool = False, mode: str = "same") -> DataFrame:
    def extract(cube: np.ndarray) -> tuple:
        table = _tables(cube, atom, scales, fps, mode)
        mask = maxima(table, thres)
        if apart:
            for i in np.ndindex(mask.shape[:2]):
                mask[i] = separate(mask[i], table[i], scales, fps)
        i, c, s, t = np.nonzero(mask)
        return i, c, s, np.asarray(scales, float)[s], t, table[mask]

    return found_extractor(frames, channels, extract, "scale_idx int, scale double, frame int, value double")


def rescale(x: np.ndarray, n: int) -> np.ndarray:
    """Linear interpolation to n places; missing places are passed over."""
    known = ~np.isnan(x)
    if not known.any():
        return np.full(n, np.nan)
    return np.interp(np.linspace(0, len(x) - 1, n), np.flatnonzero(known), x[known])


def atom_at(name: str, scale: float, pos: int, n: int, fps: float) -> np.ndarray:
    """The unit-norm atom centred at ``pos``, cut to a series of n frames."""
    w = weights(name, scale, fps, p=2.0)
    h = len(w) // 2
    out = np.zeros(n)
    a, b = max(pos - h, 0), min(pos + h + 1, n)
    out[a:b] = w[a - pos + h : b - pos + h]
    return out


def pursue(rows: np.ndarray, atoms: list[str], scales: list[float], fps: float, tol: float = 0.1, rounds: int = 10, method: str = "max", thres: float = 0.8, mode: str = "same") -> list[list[tuple[str, int, int, float]]]:
    """Matching pursuit of each row: each round adds the atoms at the maximum, or at all (separated) maxima, and refits all by least squares.

    The rest of all rows that are not done is transformed at once. Missing places take no part: responses pass over
    them as ``mode`` says, and fits and rests are those of the known places.
    """
    n, known = rows.shape[1], ~np.isnan(rows)
    rows = np.where(known, rows, 0.0)
    chosen: list[dict[tuple[str, int, int], np.ndarray]] = [{} for _ in rows]
    coef: list[np.ndarray] = [np.empty(0) for _ in rows]
    rest, open_rows = rows.astype(float), np.arange(len(rows))
    size = np.maximum(np.linalg.norm(rows, axis=1), 1e-12)
    for _ in range(rounds):
        open_rows = open_rows[np.linalg.norm(rest[open_rows], axis=1) > tol * size[open_rows]]
        if not open_rows.size:
            break
        seen = rest[open_rows] if mode == "same" else np.where(known[open_rows], rest[open_rows], np.nan)
        tables = np.stack([_tables(seen[:, None], a, scales, fps, mode)[:, 0] for a in atoms], axis=1)  # rows, atoms, scales, frames
        if method == "max":
            flat = np.abs(tables).reshape(len(open_rows), -1).argmax(axis=1)
            new = [[np.unravel_index(k, tables.shape[1:])] for k in flat]
        else:
            masks = maxima(tables, thres)
            if method == "separated":
                for i in np.ndindex(masks.shape[:2]):
                    masks[i] = separate(masks[i], tables[i], scales, fps)
            new = [list(map(tuple, np.argwhere(m))) for m in masks]
        going = []
        for row, places in zip(open_rows.tolist(), new):
            fresh = [k for a, s, t in places if (k := (atoms[a], int(s), int(t))) not in chosen[row]]
            if not fresh:
                continue
            chosen[row].update({k: atom_at(k[0], scales[k[1]], k[2], n, fps) for k in fresh})
            basis = np.stack(list(chosen[row].values()), axis=1) * known[row][:, None]
            coef[row] = np.linalg.lstsq(basis, rows[row], rcond=None)[0]
            rest[row] = rows[row] - basis @ coef[row]
            going.append(row)
        open_rows = np.array(going, int)
    return [[(a, s, t, float(v)) for (a, s, t), v in zip(c, w)] for c, w in zip(chosen, coef)]


def pursuit(frames: DataFrame, channels: list[str], atoms: list[str], scales: list[float], fps: float, **how) -> DataFrame:
    def extract(cube: np.ndarray) -> tuple:
        found = pursue(cube.reshape(-1, cube.shape[2]), atoms, scales, fps, **how)
        flat = [(i // len(channels), i % len(channels), a, s, float(scales[s]), t, v) for i, row in enumerate(found) for a, s, t, v in row]
        return tuple(zip(*flat)) if flat else ((),) * 7

    return found_extractor(frames, channels, extract, "atom string, scale_idx int, scale double, pos int, amp double")


def distinct_atoms(chosen: DataFrame) -> DataFrame:
    return chosen.dropDuplicates(["subject", "stimulus", "channel", "atom", "scale_idx", "pos"])


def rebuild_signal(chosen: DataFrame, lengths: DataFrame, fps: float) -> DataFrame:
    """(subject, stimulus, channel, frame, value): the sum of all atoms' weights at their places, cut to the series."""
    spark = chosen.sparkSession
    known = [(r["atom"], r["scale"]) for r in chosen.select("atom", "scale").distinct().collect()]  # the bank, not the data
    rows = []
    for name, scale in known:
        w = weights(name, scale, fps, p=2.0)
        rows += [(name, scale, k - len(w) // 2, float(v)) for k, v in enumerate(w)]
    kernel = spark.createDataFrame(rows, "atom string, scale double, offset int, weight double")
    spread = chosen.join(F.broadcast(kernel), ["atom", "scale"]).select(
        "subject", "stimulus", "channel", (F.col("pos") + F.col("offset")).alias("frame"), (F.col("amp") * F.col("weight")).alias("part")
    )
    inside = spread.join(F.broadcast(lengths), "stimulus").where((F.col("frame") >= 0) & (F.col("frame") < F.col("n_frames")))
    return inside.groupBy("subject", "stimulus", "channel", "frame").agg(F.sum("part").alias("value"))


#: Rows of a kernel table up to which it is broadcast.
KERNEL_ROWS = 200_000


def word_kernels(words: DataFrame, scales: list[float], fps: float) -> DataFrame:
    """(cluster, scale, offset, weight): each word (cluster, word) stretched to the width of each scale, by linear interpolation."""
    widths = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("scale"), F.lit(half_width(s, fps)).alias("half")) for s in scales])).alias("s")
    placed = words.select("cluster", "word", widths).select("cluster", "word", "s.*").select("*", F.explode(F.sequence(-F.col("half"), F.col("half"))).alias("offset"))
    place = F.when(F.col("half") > 0, (F.col("offset") + F.col("half")) * (F.size("word") - 1) / (2.0 * F.col("half"))).otherwise(0.0)
    left = F.floor("place").cast("int")
    low, high = F.get("word", left), F.get("word", F.least(left + 1, F.size("word") - 1))
    return placed.withColumn("place", place).select("cluster", "scale", "offset", (low + (high - low) * (F.col("place") - left)).alias("weight"))


def rebuild_from_words(found: DataFrame, words: DataFrame, lengths: DataFrame, scales: list[float], fps: float) -> DataFrame:
    """(subject, stimulus, channel, frame, value): each pattern's word at its scale, place and amplitude, summed, cut to the series.

    ``found``: subject, stimulus, channel, scale, pos, amp, cluster; ``words``: cluster, word, as many numbers as one likes.
    The words' kernels are a table made from data: it is broadcast up to ``KERNEL_ROWS`` rows and exchanged beyond.
    """
    kernel = word_kernels(words, scales, fps)
    few = kernel.limit(KERNEL_ROWS + 1).count() <= KERNEL_ROWS
    spread = found.join(F.broadcast(kernel) if few else kernel, ["cluster", "scale"]).select(
        "subject", "stimulus", "channel", (F.col("pos") + F.col("offset")).alias("frame"), (F.col("amp") * F.col("weight")).alias("part")
    )
    inside = spread.join(F.broadcast(lengths), "stimulus").where((F.col("frame") >= 0) & (F.col("frame") < F.col("n_frames")))  # the calendar
    return inside.groupBy("subject", "stimulus", "channel", "frame").agg(F.sum("part").alias("value"))


def mine_patterns(frames: DataFrame, channels: list[str], atom: str, scales: list[float], fps: float, thres: float, length: int = 16, mode: str = "same") -> DataFrame:
    """(.., channel, scale, pos, amp, pattern): the signal around each scale-space maximum, over its coefficient, at one length.

    Missing places are passed over, in responses as ``mode`` says, in patterns by interpolation.
    """

    def extract(cube: np.ndarray) -> tuple:
        table, n = _tables(cube, atom, scales, fps, mode), cube.shape[2]
        out: list[tuple] = []
        for i, c, s, t in np.argwhere(maxima(table, thres)).tolist():
            h, amp = len(weights(atom, scales[s], fps)) // 2, table[i, c, s, t]
            part = np.full(2 * h + 1, np.nan)
            a, b = max(t - h, 0), min(t + h + 1, n)
            part[a - t + h : b - t + h] = cube[i, c, a:b] / amp
            out.append((i, c, float(scales[s]), t, float(amp), rescale(part, length)))
        return tuple(zip(*out)) if out else ((),) * 6

    return found_extractor(frames, channels, extract, "scale double, pos int, amp double, pattern array<double>")


def reflected(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Centred convolution of the series continued by odd reflection."""
    h, n = len(kernel) // 2, x.shape[-1]
    padded, begin = odd_reflect(x, n + 2 * h)
    return fft_convolve(padded, kernel)[..., begin : begin + n]


def convolve_reflected(frames: DataFrame, channels: list[str], name: str, scale: float, fps: float) -> DataFrame:
    def extract(cube: np.ndarray) -> Iterator[tuple]:
        yield np.arange(cube.shape[2]), reflected(cube, weights(name, scale, fps))

    return cube_extractor(frames, channels, extract, "frame int, value double")


def adjoint(space: dict[str, np.ndarray], scales: list[float], fps: float) -> np.ndarray:
    """The sum of every atom at every scale and frame times its coefficient: the transform's adjoint."""
    return sum(fft_convolve(line, weights(a, s, fps, p=2.0)) for a, table in space.items() for s, line in zip(scales, table))


def dictionary_inverse(frames: DataFrame, channels: list[str], atoms: list[str], scales: list[float], fps: float) -> DataFrame:
    """Each series through the transform and its adjoint."""

    def extract(m: np.ndarray) -> Iterator[tuple]:
        for c, row in zip(channels, m):
            yield c, np.arange(len(row)), adjoint(scale_space(row, atoms, scales, fps), scales, fps)

    return series_extractor(frames, extract, "channel string, frame int, value double")


def dictionary_fill(x: np.ndarray, atoms: list[str], scales: list[float], fps: float, t: float, rounds: int = 25, tol: float = 1e-3) -> np.ndarray:
    """Missing places of series along the last axis filled by coefficients that are moved along the residual of the known places and shrunk by ``t``.

    Each series stops by itself, once it moves by no more than ``tol`` of its size; the step is one for all of a length.
    """
    rows = x.reshape(-1, x.shape[-1])
    known = ~np.isnan(rows)
    goal = np.where(known, rows, 0.0)
    probe = np.ones(rows.shape[1])
    for _ in range(10):  # the largest gain of transform and adjoint bounds the step
        probe = adjoint(scale_space(probe, atoms, scales, fps), scales, fps)
        gain = np.linalg.norm(probe)
        probe = probe / max(gain, 1e-12)
    out, live = np.zeros(rows.shape), np.arange(len(rows))
    space = {a: np.zeros((len(scales), *rows.shape)) for a in atoms}  # of the series that go on
    for _ in range(rounds):
        if not live.size:
            break
        step = scale_space(np.where(known[live], goal[live] - out[live], 0.0), atoms, scales, fps)
        space = {a: shrink_array(space[a] + step[a] / (1.05 * gain), t) for a in atoms}
        new = adjoint(space, scales, fps)
        moved = np.linalg.norm(new - out[live], axis=1)
        out[live] = new
        going = moved > tol * np.maximum(np.linalg.norm(new, axis=1), 1e-12)
        live, space = live[going], {a: v[:, going] for a, v in space.items()}
    return np.where(known, rows, out).reshape(x.shape)


def dictionary_inpaint(frames: DataFrame, channels: list[str], atoms: list[str], scales: list[float], fps: float, t: float) -> DataFrame:
    def extract(cube: np.ndarray) -> Iterator[tuple]:
        yield np.arange(cube.shape[2]), dictionary_fill(cube, atoms, scales, fps, t)

    return cube_extractor(frames, channels, extract, "frame int, value double", FILLED_AT_ONCE)
