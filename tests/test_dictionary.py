"""Wavelets, scale space and pursuit against direct numpy."""

import numpy as np
import pytest

from motionmill.functions import kernels
from motionmill.operators import dictionary as dc, layers as ly

FRAMES = "subject long, stimulus int, frame int, values array<double>"


@pytest.mark.parametrize("n", [1, 2, 3, 37, 64, 100])
def test_wavelet_inverts(n):
    x = np.random.default_rng(n).normal(size=n)
    assert np.allclose(dc.inverse_wavelet(dc.wavelet(x), n), x)


def test_odd_reflection():
    out, begin = dc.odd_reflect(np.array([1.0, 2.0, 4.0]), 7)
    assert begin == 2 and out.tolist() == [-2.0, 0.0, 1.0, 2.0, 4.0, 6.0, 7.0]


def test_shrink():
    x = np.array([3.0, -1.0, 0.5])
    assert dc.shrink_array(x, 1).tolist() == [2, 0, 0] and dc.shrink_array(x, 1, soft=False).tolist() == [3, 0, 0]


def test_scale_space_maxima_of_one_scale():
    assert np.argwhere(dc.maxima(np.array([[1.0, 3, 3, 2, 5]]), 0.5))[:, 1].tolist() == [1, 4]


def test_pursuit_finds_planted_atoms():
    scales = [4.0, 8.0, 16.0]
    x = 3 * dc.atom_at("gaussian", 8.0, 20, 80, 1.0) - 2 * dc.atom_at("gaussian", 16.0, 55, 80, 1.0)
    found = {(s, t): round(v, 6) for _, s, t, v in dc.pursue(x[None], ["gaussian"], scales, 1.0, tol=1e-6)[0]}
    assert found == {(1, 20): 3.0, (2, 55): -2.0}


def test_rescale_passes_over_missing_places():
    assert np.allclose(dc.rescale(np.array([0.0, np.nan, 2.0]), 5), [0, 0.5, 1, 1.5, 2])


def test_inpaint_keeps_known_places():
    x = np.sin(np.arange(64) / 9.0)
    x[10:14] = np.nan
    out = dc.inpaint(x, 0.05)
    assert not np.isnan(out).any() and np.allclose(out[~np.isnan(x)], x[~np.isnan(x)])


def test_second_layer_equals_its_parts(spark):
    x = np.random.default_rng(5).normal(size=(2, 40))
    frames = spark.createDataFrame([(1, 1, i, [float(v) for v in x[:, i]]) for i in range(40)], FRAMES)
    out = ly.second_layer(frames, ["a", "b"], [("gaussian", 8.0)], [8.0], 1.0).toPandas()
    first = kernels.fft_convolve(x, kernels.weights("gaussian", 8.0, 1.0))
    near = lambda v: kernels.fft_convolve(v, kernels.weights("average", 8.0, 1.0))
    stats = {"mean": near(first), "var": near(first * first) - near(first) ** 2, "cumul": near(np.abs(first))}
    for _, r in out.iterrows():
        a, b = kernels.window_bounds(40, 8.0, 1.0)[r["window"]]
        assert np.isclose(r["value"], stats[r["stat"]]["ab".index(r["channel"])][a:b].max())


@pytest.mark.parametrize("mode", ["weight", "receptive"])
def test_masked_responses_equal_plain_sums(mode):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3, 2, 50))
    x[rng.random(x.shape) < 0.3] = np.nan
    x[0, 0, :30] = np.nan
    for name in ("gaussian", "derivative"):
        w = kernels.weights(name, 8.0, 1.0, p=2.0)
        got, h = dc.responses(x, [w[::-1]], mode)[0], len(w) // 2
        for at in np.ndindex(x.shape):
            top = under = 0.0
            for o in range(-h, h + 1):
                t = at[2] + o
                if 0 <= t < 50 and not np.isnan(x[at[0], at[1], t]):
                    top += x[at[0], at[1], t] * w[o + h]
                    under += w[o + h] if mode == "weight" else 1
            assert np.isclose(got[at], top / (under if under >= dc.LEAST_WEIGHT else 1.0))
    with pytest.raises(ValueError):
        dc.responses(x, [w], "unheard")


def test_pursuit_passes_over_gaps():
    scales = [4.0, 8.0, 16.0]
    x = 3 * dc.atom_at("gaussian", 8.0, 20, 80, 1.0) - 2 * dc.atom_at("gaussian", 16.0, 55, 80, 1.0)
    x[[19, 30, 31, 60]] = np.nan
    found = dc.pursue(x[None], ["gaussian"], scales, 1.0, tol=1e-6, rounds=12, mode="receptive")[0]
    known = ~np.isnan(x)
    rebuilt = sum(v * dc.atom_at(a, scales[s], t, 80, 1.0) for a, s, t, v in found)
    assert np.linalg.norm((rebuilt - np.nan_to_num(x))[known]) < 0.35 * np.linalg.norm(x[known])
    basis = np.stack([dc.atom_at(a, scales[s], t, 80, 1.0) for a, s, t, _ in found], axis=1)[known]
    assert np.allclose(basis @ np.array([v for *_, v in found]), basis @ np.linalg.lstsq(basis, x[known], rcond=None)[0])


@pytest.mark.parametrize("most", [200_000, 3])
def test_words_are_laid_at_their_places(spark, monkeypatch, most):
    monkeypatch.setattr(dc, "KERNEL_ROWS", most)
    words = {0: [0.0, 1.0, 0.0], 1: [1.0, 2.0, 4.0, 8.0, 16.0]}
    found = [(1, 1, "a", 8.0, 10, 2.0, 0), (1, 1, "a", 4.0, 11, -1.0, 1), (1, 1, "a", 8.0, 0, 1.0, 1), (2, 1, "b", 1.0, 19, 3.0, 1)]
    df = spark.createDataFrame(found, "subject long, stimulus int, channel string, scale double, pos int, amp double, cluster int")
    table = spark.createDataFrame(list(words.items()), "cluster int, word array<double>")
    lengths = spark.createDataFrame([(1, 20)], "stimulus int, n_frames int")
    got = {(r["subject"], r["channel"], r["frame"]): r["value"] for r in dc.rebuild_from_words(df, table, lengths, [1.0, 4.0, 8.0], 1.0).collect()}
    want: dict = {}
    for subject, _, channel, scale, pos, amp, cluster in found:
        h = kernels.half_width(scale, 1.0)
        line = dc.rescale(np.array(words[cluster]), 2 * h + 1) if h else np.array(words[cluster][:1])
        for o in range(-h, h + 1):
            if 0 <= pos + o < 20:
                key = (subject, channel, pos + o)
                want[key] = want.get(key, 0.0) + amp * line[o + h]
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


def gapped(rows: int, n: int) -> np.ndarray:
    rng = np.random.default_rng(n)
    x = np.cumsum(rng.normal(size=(rows, n)), axis=1)
    x[rng.random(x.shape) < 0.6] = np.nan
    x[0] = np.nan
    return x


@pytest.mark.parametrize("n", [1, 38, 50])
def test_series_are_inpainted_together_as_alone(n):
    x = gapped(12, n)
    assert np.allclose(dc.inpaint(x.reshape(3, 4, n), 0.5).reshape(12, n), [dc.inpaint(row, 0.5) for row in x])


@pytest.mark.parametrize("n", [1, 38, 50])
def test_series_are_filled_by_a_dictionary_together_as_alone(n):
    x, how = gapped(12, n), (["gaussian"], [4.0, 8.0, 16.0], 1.0, 0.1)
    assert np.allclose(dc.dictionary_fill(x.reshape(3, 4, n), *how).reshape(12, n), [dc.dictionary_fill(row, *how) for row in x])
