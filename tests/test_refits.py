"""Refits, ranks by ranges, trees and densities against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionmill.operators import density as dn, design as dz, dictionary as dc, evaluate as ev, leave_out as lo, models as md, refits as rf

GRID = [("ridge", "gamma", 0.5), ("pursuit", "m", 3.0), ("lasso", "gamma", 0.05), ("elimination", "keep", 2.0), ("least_squares", "gamma", 0.0)]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    y = rng.choice([1, -1], 60, p=[0.4, 0.6])
    return rng.normal(size=(60, 5)) + np.outer(y, [1, 0.5, 0, 0, 0]), y


@pytest.fixture(scope="module")
def vectors(spark, data):
    x, y = data
    return spark.createDataFrame([(i, [float(a) for a in r], int(l)) for i, (r, l) in enumerate(zip(x, y))], "subject long, vector array<double>, label int").repartition(3)


def sums(x, y):
    one = np.c_[x, np.ones(len(x))]
    return rf.Sums(one.T @ one, one[y == 1].sum(axis=0), one[y == -1].sum(axis=0), (y == 1).sum(), (y == -1).sum())


def targets(y):
    return np.where(y == 1, 2 * (y == -1).mean(), -2 * (y == 1).mean())


def test_fits_equal_fits_on_rows(data):
    x, y = data
    one, t = np.c_[x, np.ones(len(x))], targets(y)
    s = sums(x, y)
    assert np.allclose(rf.ridge(s, 0.5), np.linalg.solve(one.T @ one + 0.5 * np.eye(6), one.T @ t))
    assert np.allclose(rf.least_squares(s, 0), np.linalg.lstsq(one, t, rcond=None)[0])
    w = rf.lasso(s, 0.05)
    slope = one.T @ (t - one @ w) / len(y)  # optimal: the slope is gamma on weights in use, less elsewhere, 0 for the constant
    assert abs(slope[-1]) < 1e-6 and all(abs(slope[k] - 0.05 * np.sign(w[k])) < 1e-6 if w[k] else abs(slope[k]) <= 0.05 + 1e-6 for k in range(5))
    rest, chosen = t.copy(), []
    for _ in range(3):
        c = np.abs(one.T @ rest)
        c[chosen] = -1
        chosen.append(int(c.argmax()))
        rest = t - one[:, chosen] @ np.linalg.lstsq(one[:, chosen], t, rcond=None)[0]
    assert set(np.flatnonzero(rf.pursuit(s, 3))) == set(chosen)
    assert np.flatnonzero(rf.elimination(s, 2)[:-1]).size == 2


def test_folds_equal_refits_on_rows(spark, vectors, data):
    x, y = data
    folds = ev.stratified_folds(vectors.select("subject", "label"), 4)
    of = {r["subject"]: r["fold"] for r in folds.collect()}
    f = np.array([of[i] for i in range(60)])
    out = {(r["model"], r["subject"]): r["score"] for r in rf.cross_evaluate(vectors, folds, GRID).collect()}
    for name, _, value in GRID:
        for k in range(4):
            w = rf.FITS[name](sums(x[f != k], y[f != k]), value)
            for i in np.flatnonzero(f == k):
                assert np.isclose(out[name, i], x[i] @ w[:-1] + w[-1])
    scored = {(r["model"], r["fold"]): r["score"] for r in rf.fold_scores(rf.cross_evaluate(vectors, folds, GRID[:1])).collect()}
    for k in range(4):
        s = np.array([out["ridge", i] for i in np.flatnonzero(f == k)])
        z = y[f == k]
        assert np.isclose(scored["ridge", k], np.mean([a > b for a in s[z == 1] for b in s[z == -1]]))
    picked = rf.cross_evaluate(vectors, folds, GRID[:1], select=rf.best_gaps(2)).collect()
    assert len(picked) == 60


def test_neighbours_equal_brute_force(vectors, data, monkeypatch):
    x, y = data
    monkeypatch.setattr(rf, "BLOCK", 7)
    folds = ev.stratified_folds(vectors.select("subject", "label"), 4)
    f = np.array([r["fold"] for r in folds.orderBy("subject").collect()])
    out = {(r["params"], r["subject"]): r["score"] for r in rf.neighbours_in_folds(vectors, folds, [1, 5]).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    for i in range(60):
        near = [j for j in np.lexsort((np.arange(60), d[i])) if f[j] != f[i]]
        for k in (1, 5):
            assert np.isclose(out[f"k={k}", i], y[near[:k]].mean())


def test_leaving_out_rows_and_pairs(vectors, data):
    x, y = data
    one = {r["subject"]: r["score"] for r in rf.leave_one_out(vectors, GRID[:1]).collect()}
    for i in range(60):
        rest = np.arange(60) != i
        w = rf.ridge(sums(x[rest], y[rest]), 0.5)
        assert np.isclose(one[i], x[i] @ w[:-1] + w[-1])
    pairs = ev.opposite_pairs(vectors.select("subject", "label"), 12)
    told = rf.pair_refits(vectors, pairs, GRID).collect()
    assert len(told) == pairs.count() * len(GRID)
    for r in told:
        rest = ~np.isin(np.arange(60), [r["pos"], r["neg"]])
        value = next(v for m, _, v in GRID if m == r["model"])
        w = rf.FITS[r["model"]](sums(x[rest], y[rest]), value)
        assert y[r["pos"]] == 1 and y[r["neg"]] == -1 and np.isclose(r["s_pos"], x[r["pos"]] @ w[:-1] + w[-1]) and np.isclose(r["s_neg"], x[r["neg"]] @ w[:-1] + w[-1])
    swept = rf.best_settings(rf.cross_evaluate(vectors, ev.stratified_folds(vectors.select("subject", "label"), 4), GRID), rf.pair_refits(vectors, pairs, GRID), keep=0.5).collect()
    assert len(swept) == len(GRID) and all(np.isclose(r["score"], r["accuracy"] * (1 - r["ties"]) + r["auc"]) for r in swept)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("most", [1_000_000, 60, 9])
def test_running_sums_equal_a_plain_loop(spark, descending, most):
    rng = np.random.default_rng(1)
    # a third of the rows share one value, and one row in twenty has none
    rows = [(int(rng.integers(3)), int(i), None if rng.random() < 0.05 else 7.0 if rng.random() < 0.3 else float(rng.integers(30)), float(rng.integers(9))) for i in range(700)]
    df = spark.createDataFrame(rows, "g int, subject long, value double, w double").repartition(5)
    out = ev.running(df, ["g"], "value", "subject", {"n": F.lit(1), "t": F.col("w")}, descending=descending, previous="before", rows=most)
    got = {(r["g"], r["subject"]): (r["n"], r["t"], r["before"], r["all_n"], r["all_t"]) for r in out.collect()}
    for g in range(3):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-np.inf if r[2] is None else r[2], r[1]), reverse=descending)
        total = 0.0
        for k, r in enumerate(mine):
            total += r[3]
            assert got[g, r[1]] == (k + 1, total, mine[k - 1][2] if k else None, len(mine), sum(m[3] for m in mine))
    assert len(got) == 700


def test_no_range_holds_a_value_that_many_share(spark):
    df = spark.createDataFrame([(i, 7.0 if i % 2 else float(i % 50)) for i in range(4000)], "subject long, value double").withColumn("g", F.lit(1))
    cells = ev._ranged(df, ["g"], "value", "subject", 40, 100).groupBy("_range", "_part").count()
    assert cells.agg(F.max("count")).first()[0] <= 250 and cells.agg(F.sum("count")).first()[0] == 4000


def test_exact_quantiles(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(v)) for g in (1, 2) for v in rng.integers(0, 40, 101 * g)]
    out = {r["g"]: r["q"] for r in dn.exact_quantiles(spark.createDataFrame(rows, "g int, value double"), ["g"], [0.0, 0.05, 0.5, 0.95, 1.0]).collect()}
    for g in (1, 2):
        v = np.sort([x for k, x in rows if k == g])
        assert out[g] == [v[max(int(np.ceil(round(p * len(v), 9))) - 1, 0)] for p in (0.0, 0.05, 0.5, 0.95, 1.0)]


def test_separated_maxima_equal_a_plain_loop():
    rng = np.random.default_rng(3)
    scales, fps = [1.0, 2.0, 4.0], 2.0
    for _ in range(50):
        table = rng.normal(size=(3, 40)).round(1)
        mask = dc.maxima(table, 0.3)
        kept, place, value = [], None, None
        for s in range(3):
            for t in range(40):
                if mask[s, t]:
                    if place is not None and abs(t - place) < fps * scales[s]:
                        if value < abs(table[s, t]):
                            kept[-1], value = (s, t), abs(table[s, t])
                        continue
                    place, value = t, abs(table[s, t])
                    kept.append((s, t))
        assert np.argwhere(dc.separate(mask, table, scales, fps)).tolist() == sorted(map(list, kept))


def test_pursuit_in_rows_equals_one_by_one():
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(6, 50))
    for method in ("max", "maxima", "separated"):
        together = dc.pursue(rows, ["gaussian"], [4.0, 8.0], 1.0, rounds=3, method=method)
        assert together == [dc.pursue(r[None], ["gaussian"], [4.0, 8.0], 1.0, rounds=3, method=method)[0] for r in rows]
        for r, found in zip(rows, together):
            basis = np.stack([dc.atom_at(a, [4.0, 8.0][s], t, 50, 1.0) for a, s, t, _ in found], axis=1)
            assert np.allclose(np.linalg.lstsq(basis, r, rcond=None)[0], [v for *_, v in found])


def test_wavelets_keep_what_is_missing_missing():
    x = np.sin(np.arange(50.0))
    whole = dc.wavelet(x)
    x[20] = np.nan
    for a, b in zip(whole, dc.wavelet(x)):
        known = ~np.isnan(b)
        assert np.allclose(a[known], b[known]) and not known.all()


def test_tree_parts_planted_classes(spark):
    rng = np.random.default_rng(5)
    rows = [(s, f, float(rng.normal(0, 0.1) + (5 * (s % 2) if f == 2 else 0)), 1 if s % 2 else -1) for s in range(60) for f in range(4)]
    design = spark.createDataFrame(rows, "subject long, feature_id long, value double, label int")
    nodes = md.purity_tree(design)
    assert nodes[0]["feature_id"] == 2 and {n["side"] for n in nodes[1:]} == {1, -1} and len(nodes) == 3
    vectors = design.groupBy("subject", "label").agg(F.sort_array(F.collect_list(F.struct("feature_id", "value")))["value"].alias("vector"))
    assert all(r["score"] == r["label"] for r in md.tree_score(vectors, nodes).collect())
    few = md.purity_tree(design.where("subject < 6"))
    assert "w" in few[0] and all(np.sign(r["score"]) == r["label"] for r in md.tree_score(vectors.where("subject < 6"), few).collect())
    by_median = lambda r, _: r.where("feature_id = 2").groupBy("node", "feature_id").agg(F.median("value").alias("cut"))
    assert md.purity_tree(design, split=by_median)[0]["feature_id"] == 2


def test_pursuit_takes_plain_or_normed_correlations(spark):
    rng = np.random.default_rng(6)
    y = rng.choice([1, -1], 80)
    x = np.c_[0.01 * y, rng.normal(size=80) * 5 + y]
    v = spark.createDataFrame([(i, [float(a) for a in r], int(l), float(l)) for i, (r, l) in enumerate(zip(x, y))], "subject long, vector array<double>, label int, target double")
    assert md.matching_pursuit(v, "target", 1)[0] == [1] and md.matching_pursuit(v, "target", 1, normed=True)[0] == [0]
    assert len(md.matching_pursuit(v, "target", 2, normed=True, stop=0.95)[0]) == 1


def test_binned_densities_are_near_exact_ones(spark):
    rng = np.random.default_rng(7)
    design = spark.createDataFrame([(i, f, float(v), 1) for f in range(3) for i, v in enumerate(rng.normal(0, 1 + f, 200))] + [(i, 9, 1.0, 1) for i in range(5)], "subject long, feature_id long, value double, label int")
    exact = {(r["subject"], r["feature_id"]): r["density"] for r in dn.density_at_points(design).collect()}
    binned = {(r["subject"], r["feature_id"]): r["density"] for r in dn.density_binned(design).collect()}
    assert exact.keys() == binned.keys() and all(abs(exact[k] - binned[k]) < 1e-3 * max(exact.values()) for k in exact)


WIDE = [("ridge", "gamma", 0.5), ("pursuit", "m", 3.0), ("lasso", "gamma", 0.05), ("elimination", "keep", 4.0), ("least_squares", "gamma", 0.0), ("sparse", "gamma", 0.05)]


@pytest.mark.parametrize("m", [1, 2, 3])
def test_batches_of_sets_left_out_equal_fits_one_by_one(m):
    rng = np.random.default_rng(m)
    y = rng.choice([1, -1], 80)
    x = rng.normal(size=(80, 12)) + np.outer(y, [1, 0.7] + [0] * 10)
    every = sums(x, y)
    sets = np.array([rng.choice(80, m, replace=False) for _ in range(30)])
    out_x, out_y = np.c_[x, np.ones(80)][sets], y[sets].copy()
    out_y[5, -1] = 0  # one set has a row less
    for name, _, value in WIDE:
        w = lo.weights(every, out_x, out_y, name, value, {})
        for r, s in enumerate(sets):
            keep = np.ones(80, bool)
            keep[s[out_y[r] != 0]] = False
            assert np.allclose(w[r], rf.FITS[name](sums(x[keep], y[keep]), value), atol=1e-6), (name, r)


def test_a_row_that_alone_fills_a_direction_can_be_left_out():
    x = np.zeros((12, 3))
    x[:, 0] = np.arange(12)
    x[0, 2] = 1.0  # the only row with this feature
    y = np.array([1, -1] * 6)
    w = lo.weights(sums(x, y), np.c_[x, np.ones(12)][:, None], y[:, None], "least_squares", 0.0, {})
    for r in range(12):
        keep = np.arange(12) != r
        assert np.allclose(w[r], rf.least_squares(sums(x[keep], y[keep]), 0.0), atol=1e-7)


def test_callers_fits_are_used(spark, vectors):
    flat = {**rf.FITS, "flat": lambda s, v: np.full(len(s.pos), v), "ridge": lambda s, v: np.zeros(len(s.pos))}
    got = {r["model"]: r["score"] for r in rf.leave_one_out(vectors.where("subject = 0"), [("flat", "v", 2.0), ("ridge", "gamma", 1.0)], flat).collect()}
    assert got["ridge"] == 0 and got["flat"] != 0


def test_too_wide_vectors_raise(vectors):
    with pytest.raises(ValueError, match="choose features"):
        md.check_width(vectors, 4)


def test_oblique_classes_are_told_apart_by_linear_splits(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(120, 6))
    y = np.where(x[:, 1] + x[:, 4] > 0, 1, -1)
    y[(x[:, 1] + x[:, 4] > 0) & (x[:, 1] - x[:, 4] > 1)] = -1  # two oblique cuts
    design = spark.createDataFrame([(s, f, float(x[s, f]), int(y[s])) for s in range(120) for f in range(6)], "subject long, feature_id long, value double, label int")
    vectors = spark.createDataFrame([(s, [float(a) for a in x[s]], int(y[s])) for s in range(120)], "subject long, vector array<double>, label int")
    nodes = md.purity_tree(design, depth=5, split=md.linear_split(4))
    assert "w" in nodes[0] and len(nodes[0]["w"]) == 5 and {1, 4} <= set(nodes[0]["w"])
    told = {r["subject"]: r["score"] for r in md.tree_score(vectors, nodes).collect()}
    assert np.mean([np.sign(told[s]) == y[s] for s in range(120)]) >= 0.9
    by_gap = {r["subject"]: r["score"] for r in md.tree_score(vectors, md.purity_tree(design, depth=5)).collect()}
    assert np.mean([np.sign(told[s]) == y[s] for s in told]) >= np.mean([np.sign(by_gap[s] or 0) == y[s] for s in by_gap])


def test_linear_split_equals_a_fit_on_rows(spark):
    rng = np.random.default_rng(12)
    x, y = rng.normal(size=(50, 3)), rng.choice([1, -1], 50)
    design = spark.createDataFrame([(s, f, float(x[s, f]), int(y[s])) for s in range(50) for f in range(3)], "subject long, feature_id long, value double, label int").withColumn("node", F.lit(1))
    got = {r["feature_id"]: r["weight"] for r in md.linear_split(3)(design, 0).collect()}
    gap = np.round(np.abs(x[y == 1].mean(axis=0) - x[y == -1].mean(axis=0)) / x.std(axis=0), 9)
    order = np.lexsort((np.arange(3), -gap))
    one, c = np.c_[x[:, order], np.ones(50)], np.where(y == 1, 1 / (y == 1).sum(), 1 / (y == -1).sum())
    xx = (one.T * c) @ one
    w = np.linalg.solve(xx + 0.1 * np.diag([1.0, 1, 1, 0]) * np.trace(xx) / 4, one.T @ (c * y))
    assert np.allclose([got[int(f)] for f in order] + [got[-1]], w)


@pytest.mark.parametrize("k", [2, 3])
def test_densities_on_axes_equal_plain_products(spark, k):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(90, 5)) @ rng.normal(size=(5, 5))
    design = spark.createDataFrame([(s, f, float(x[s, f]), 1) for s in range(90) for f in range(5)], "subject long, feature_id long, value double, label int")
    group, points = sorted([3, 0, 4][:k], key=lambda f: -(x[:, f] ** 2).sum()), 5  # the larger first, so that signs are those of the plane
    got = {r["cell"]: (r["x"], r["density"]) for r in dn.density_on_axes(design, [group], points).collect()}
    v = x[:, group]
    axes = dn.principal_axes(v.T @ v)
    turned = v @ axes.T
    assert np.allclose(axes @ axes.T, np.eye(k)) and len(got) == points**k
    h, lines = turned.var(axis=0) * 90 ** (-1 / (k + 4)), []
    for i in range(k):
        s = np.sort(turned[:, i])
        lines.append(np.linspace(s[int(np.ceil(0.05 * 90)) - 1], s[int(np.ceil(round(0.95 * 90, 9))) - 1], points))
    for cell, place in enumerate(np.ndindex(*[points] * k)):
        at = np.array([lines[i][p] for i, p in enumerate(place)])
        want = (np.exp(-0.5 * ((at - turned) / h) ** 2) / (h * np.sqrt(2 * np.pi))).prod(axis=1).mean()
        assert np.allclose(got[cell][0], at) and np.isclose(got[cell][1], want)
    if k == 2:
        pairs = spark.createDataFrame([tuple(group)], "first long, second long")
        plane = dn.density_on_plane(design, pairs, points).collect()
        assert len(plane) == points**2 and all(np.allclose([r["x"], r["y"], r["density"]], [*got[r["i"] * points + r["j"]][0], got[r["i"] * points + r["j"]][1]]) for r in plane)
    with pytest.raises(ValueError, match="cells"):
        dn.density_on_axes(design, [[0, 1, 2, 3, 4]], 50)


def test_sparse_fit_without_a_weight_keeps_the_constant_alone():
    rng = np.random.default_rng(3)
    x, y = 0.01 * rng.normal(size=(80, 6)), np.array([1, -1] * 40)
    w = rf.sparse(sums(x, y), 0.05)
    assert (w[:-1] == 0).all()
    sets = np.array([rng.choice(80, 2, replace=False) for _ in range(5)])
    left = lo.weights(sums(x, y), np.c_[x, np.ones(80)][sets], y[sets], "sparse", 0.05, {})
    assert (left[:, :-1] == 0).all()


@pytest.mark.parametrize("bandwidth", ["variance", "std"])
def test_densities_by_boxes_equal_sums_over_all_pairs(spark, monkeypatch, bandwidth):
    rng = np.random.default_rng(21)
    columns = {0: rng.normal(0, 0.1, 900), 1: np.r_[rng.normal(3, 1, 899), 40.0], 2: rng.choice([0.0, 0.5, 2.0], 900), 3: 1e7 + rng.normal(0, 0.3, 900), 4: np.ones(900)}
    monkeypatch.setattr(dn, "_density_by_blocks", None)  # no pairs are made
    design = spark.createDataFrame([(i, f, float(v), 1) for f, x in columns.items() for i, v in enumerate(x)], "subject long, feature_id long, value double, label int")
    found = {(r["subject"], r["feature_id"]): r["density"] for r in dn.density_at_points(design, bandwidth).collect()}
    assert len(found) == 4 * 900
    for f in range(4):
        x = columns[f]
        h = (x.var() if bandwidth == "variance" else x.std()) * 900**-0.2
        z = (x[:, None] - x[None]) / h
        assert np.allclose([found[i, f] for i in range(900)], np.exp(-z * z / 2).mean(axis=1) / (h * np.sqrt(2 * np.pi)), rtol=1e-6 if f == 3 else 1e-11, atol=0)


def test_density_of_values_far_apart_for_their_bandwidth(spark):
    x = np.random.default_rng(2).normal(0, 1e-9, 60)
    design = spark.createDataFrame([(i, 0, float(v), 1) for i, v in enumerate(np.r_[x, x[:5]])] + [(i, 1, float(i % 7), 1) for i in range(65)], "subject long, feature_id long, value double, label int")
    found = {(r["subject"], r["feature_id"]): r["density"] for r in dn.density_at_points(design).collect()}
    x = np.r_[x, x[:5]]
    h = x.var() * 65**-0.2
    z = (x[:, None] - x[None]) / h
    assert len(found) == 130 and np.allclose([found[i, 0] for i in range(65)], np.exp(-z * z / 2).mean(axis=1) / (h * np.sqrt(2 * np.pi)), rtol=1e-9)


def test_quantiles_of_large_groups_without_sorting_them(spark, monkeypatch):
    monkeypatch.setattr(ev, "ROWS", 100)
    monkeypatch.setattr(dn, "running", None)  # no group is ranked whole
    rng = np.random.default_rng(8)
    groups = {"a": rng.normal(size=30_000).round(3), "b": np.r_[np.zeros(900), rng.normal(size=100)], "c": np.array([2.0, 1.0, 3.0]), None: np.arange(700.0)}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("a", None)]
    levels = [0.0, 0.05, 0.2, 0.5, 0.95, 1.0]
    found = {r["k"]: r["q"] for r in dn.exact_quantiles(spark.createDataFrame(rows, "k string, value double").repartition(4), ["k"], levels).collect()}
    assert found == {k: [np.sort(x)[max(int(np.ceil(round(p * len(x), 9))), 1) - 1] for p in levels] for k, x in groups.items()}
