"""Curves, folds, pair scores and splits against hand-worked numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionmill.operators import design as dz, evaluate as ev, models as md, refits as rf

SCORES = "subject long, score double, label int"


@pytest.fixture
def four(spark):
    return spark.createDataFrame([(1, 4.0, 1), (2, 3.0, -1), (3, 2.0, 1), (4, 1.0, -1)], SCORES)


def test_roc(four):
    out = ev.roc_curve(four).orderBy(F.desc("score")).collect()
    assert [r["fpr"] for r in out] == [0, 0.5, 0.5, 1] and [r["tpr"] for r in out] == [0.5, 0.5, 1, 1]
    assert ev.auc(four).first()["auc"] == 0.75


def test_precision_recall(four):
    curve = ev.precision_recall_curve(four)
    out = curve.orderBy(F.desc("score")).collect()
    assert np.allclose([r["precision"] for r in out], [1, 0.5, 2 / 3, 0.5]) and [r["recall"] for r in out] == [0.5, 0.5, 1, 1]
    assert ev.best_recall(curve, 0.6).first()[0] == 1


def test_auc_of_negated_scores(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(s), 1 if rng.random() < 0.4 else -1) for i, s in enumerate(rng.permutation(300))]
    df = spark.createDataFrame(rows, SCORES)
    a, b = ev.auc(df).first()[0], ev.auc(df.withColumn("score", -F.col("score"))).first()[0]
    assert np.isclose(a + b, 1)


def test_pair_score_of_two_histograms(spark):
    pos, neg = [4, 2, 21, 17, 12, 6, 10, 10, 4, 14], [56, 27, 6, 4, 4, 1, 1, 0, 0, 1]
    rows = [(float(s), label) for label, counts in ((1, pos), (-1, neg)) for s, n in enumerate(counts) for _ in range(n)]
    df = spark.createDataFrame([(i, s, l) for i, (s, l) in enumerate(rows)], SCORES)
    out = ev.pair_score(df).first()
    assert round(out["accuracy"], 6) == 0.933122 and round(out["ties"], 6) == 0.055


@pytest.mark.parametrize("n, k, sizes", [(5, 2, [2, 3]), (17, 4, [4, 4, 4, 5])])
def test_folds(spark, n, k, sizes):
    df = spark.createDataFrame([(i, 1) for i in range(n)], "subject long, label int")
    out = [r["count"] for r in ev.stratified_folds(df, k).groupBy("fold").count().orderBy("fold").collect()]
    assert sorted(out) == sizes


def test_split_keeps_unknown_labels_in_train(spark):
    df = spark.createDataFrame([(i, [1, -1, 0, None][i % 4]) for i in range(40)], "subject long, label int")
    out = ev.train_test_split(df, 0.3).collect()
    assert len(out) == 40 and sum(r["part"] == "test" for r in out) == 6
    assert all(abs(r["label"] or 0) == 1 for r in out if r["part"] == "test")


def test_gap_split(spark):
    rows = [(i, 0, float(v), 1 if v > 5 else -1) for i, v in enumerate([1, 2, 3, 10, 11, 12])]
    design = spark.createDataFrame(rows, "subject long, feature_id long, value double, label int")
    assert dz.gap_split(design, dz.extreme_purity(design), 0.2).first()["cut"] == 10


def test_empty_scores(spark):
    df = spark.createDataFrame([], SCORES)
    assert ev.roc_curve(df).count() == 0 and ev.stratified_folds(df.drop("score"), 3).count() == 0


def test_margin_triplets_equal_the_triple_loop(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(14, 3)), rng.choice([1, -1], 14)
    v = spark.createDataFrame([(i, [float(a) for a in r], int(l)) for i, (r, l) in enumerate(zip(x, y))], "subject long, vector array<double>, label int")
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    for r in md.margin_triplets(v, v).collect():
        i = r["query"]
        terms = [1 + d[i, j] - d[i, k] for j in range(14) for k in range(14) if j != i and y[j] == y[i] and y[k] != y[i]]
        assert r["n"] == sum(t > 0 for t in terms) and np.isclose(r["loss"], sum(t for t in terms if t > 0))


def test_linear_algebra_against_numpy(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(60, 5)), rng.choice([1, -1], 60)
    v = spark.createDataFrame([(i, [float(a) for a in r], int(l), float(l)) for i, (r, l) in enumerate(zip(x, y))], "subject long, vector array<double>, label int, target double").repartition(3)
    xx, xy, n = md.gram(v, ["target"])
    assert np.allclose(xx, x.T @ x) and np.allclose(xy[:, 0], x.T @ y) and n == 60
    assert np.allclose(md.least_squares(v, "target"), np.linalg.lstsq(x, y, rcond=None)[0])
    axes, _ = md.pca(v, 2)
    assert np.allclose(np.abs(axes @ np.linalg.svd(x)[2][:2].T), np.eye(2), atol=1e-6)
    assert md.select_independent(v.withColumn("vector", F.concat("vector", F.slice("vector", 1, 1))), [0, 5, 1]) == [0, 1]


def test_planted_feature_ranks_first(spark):
    rng = np.random.default_rng(4)
    rows = [(s, f, float(rng.normal() + (3 * (s % 2) if f == 7 else 0)), 1 if s % 2 else -1) for s in range(80) for f in range(12)]
    design = spark.createDataFrame(rows, "subject long, feature_id long, value double, label int")
    assert dz.top_features(dz.extreme_purity(design), 1).first()["feature_id"] == 7


def test_triplet_gradient_equals_the_triple_loop(spark):
    rng = np.random.default_rng(5)
    x, y, s = rng.normal(size=(12, 3)), rng.choice([1, -1], 12), np.diag([1.0, 2.0, 0.5])
    v = spark.createDataFrame([(i, [float(a) for a in r], int(l)) for i, (r, l) in enumerate(zip(x, y))], "subject long, vector array<double>, label int")
    g, loss, _ = md._triplet_gradient(v, v, s)
    d = np.einsum("ijk,kl,ijl->ij", x[:, None] - x[None], s, x[:, None] - x[None])
    want, total = np.zeros((3, 3)), 0.0
    for i in range(12):
        for j in range(12):
            for k in range(12):
                if j != i and y[j] == y[i] and y[k] != y[i] and (e := 1 + d[i, j] - d[i, k]) > 0:
                    total += e
                    want += np.outer(x[i] - x[j], x[i] - x[j]) - np.outer(x[i] - x[k], x[i] - x[k])
    assert np.allclose(g, want) and np.isclose(loss, total)


def test_learned_metric_tells_classes_apart(spark):
    rng = np.random.default_rng(6)
    y = rng.choice([1, -1], 60)
    x = rng.normal(size=(60, 3)) * [0.3, 3, 3] + np.outer(y, [1, 0, 0])
    v = spark.createDataFrame([(i, [float(a) for a in r], int(l)) for i, (r, l) in enumerate(zip(x, y))], "subject long, vector array<double>, label int")
    s, losses = md.metric_learning(v, v, rounds=6)
    out = {r["query"]: r["score"] for r in md.metric_score(v, v, s).collect()}
    assert losses[-1] < losses[0] and np.mean([(out[i] > 0.5) == (y[i] == 1) for i in range(60)]) > 0.8


@pytest.mark.parametrize("batch", [1, 3, 100])
def test_independent_features_in_batches_equal_one_by_one(spark, batch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(80, 12))
    x[:, 4] = x[:, 0] * 2 + 1  # a copy
    x[:, 7] = x[:, 1] + x[:, 2] + x[:, 3]  # spanned, with correlations of about 0.58
    x[:, 9] = 5.0  # constant
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "subject long, vector array<double>").repartition(3)
    order = [int(f) for f in rng.permutation(12)] + [0, 3]
    for thres in (0.2, 0.5, 0.95):
        kept: list[int] = []
        for f in dict.fromkeys(order):
            if x[:, f].std() < 1e-9:
                continue
            z = lambda g: (x[:, g] - x[:, g].mean()) / x[:, g].std()
            if kept and max(abs(z(f) @ z(g)) / 80 for g in kept) > thres:
                continue
            if kept and np.linalg.norm(z(f) - np.stack([z(g) for g in kept], axis=1) @ np.linalg.lstsq(np.stack([z(g) for g in kept], axis=1), z(f), rcond=None)[0]) < 1e-4 * np.sqrt(80):
                continue
            kept.append(f)
        assert md.select_independent(v, order, thres, batch=batch) == kept


def test_kmeans_of_all_groups_at_once(spark):
    rng = np.random.default_rng(10)
    rows = [(g, [float(a) for a in rng.normal(0, 0.1, 2) + 10 * np.array([g, i % 3])]) for g in range(4) for i in range(30)]
    v = spark.createDataFrame(rows, "event long, vector array<double>").repartition(3)
    got = {}
    for r in md.kmeans(v, 3, tries=4, by=["event"]).collect():
        got.setdefault(r["event"], []).append(r["centre"])
    for g in range(4):
        want = [np.mean([x for (h, x), i in zip(rows, list(range(30)) * 4) if h == g and i % 3 == k], axis=0) for k in range(3)]
        assert np.allclose(sorted(got[g], key=lambda c: c[1]), want)
    one = md.kmeans(v.where("event = 0").drop("event"), 3, tries=4).collect()
    assert np.allclose(sorted((r["centre"] for r in one), key=lambda c: c[1]), sorted(got[0], key=lambda c: c[1]))
    few = md.kmeans(v.where("event = 0").limit(2), 3, by=["event"]).collect()
    assert len(few) == 2 and md.kmeans(v.where("false"), 3, by=["event"]).count() == 0
    starts = spark.createDataFrame([(0, 0, k, [0.0, float(100 * k)]) for k in range(3)], "event long, t int, rn int, vector array<double>")
    assert md.kmeans(v.where("event = 0"), 3, by=["event"], starts=starts, rounds=1).count() < 3  # centres without rows go


def test_lasso_of_rows_equals_lasso_of_sums(spark):
    rng = np.random.default_rng(14)
    y = rng.choice([1, -1], 90)
    x = rng.normal(size=(90, 5)) + np.outer(y, [1, 0.4, 0, 0, 0])
    v = spark.createDataFrame([(i, [float(a) for a in r], int(c)) for i, (r, c) in enumerate(zip(x, y))], "subject long, vector array<double>, label int")
    assert np.allclose(md.lasso(v, 0.05), rf.lasso(rf.total(rf.class_sums(v)), 0.05), atol=1e-3)
    features, w = md.sparse_classifier(v, lambda rows: md.lasso(rows, 0.05), lambda rows: md.lasso(rows, 0.0), 0.1)
    assert features[0] == 0 and len(w) == len(features) + 1


def test_metric_of_all_rows_takes_every_anchor_once(spark, monkeypatch):
    rng = np.random.default_rng(16)
    y = rng.choice([1, -1], 80)
    x = rng.normal(size=(80, 3)) * [0.3, 3, 3] + np.outer(y, [1, 0, 0])
    v = spark.createDataFrame([(i, [float(a) for a in r], int(c)) for i, (r, c) in enumerate(zip(x, y))], "subject long, vector array<double>, label int").cache()
    seen, real = [], md._triplet_gradient

    def watched(anchors, rows, s):
        seen.append({r["subject"] for r in anchors.select("subject").collect()})
        return real(anchors, rows, s)

    monkeypatch.setattr(md, "_triplet_gradient", watched)
    errors: list[float] = []
    s, losses = md.metric_learning(v, rounds=4, parts=4, errors=errors)
    assert sum(map(len, seen)) == 80 and set().union(*seen) == set(range(80)) and len(errors) == 4
    whole = real(v, v, np.eye(3))[1]
    pull = losses[0] - 4 * real(v.where(F.col("subject").isin(list(seen[0]))), v, np.eye(3))[1]
    assert abs(losses[0] - pull - whole) < 3 * errors[0]  # the estimate of the first round
    after = real(v, v, s)[1]
    assert after < whole


def test_triplets_at_the_margin_are_not_active(spark):
    rows = [(0, [0.0], 1), (1, [1.0], 1), (2, [2.0], 1), (3, [1.0], -1), (4, [-2.0], -1), (5, [3.0], -1)]
    v = spark.createDataFrame(rows, "subject long, vector array<double>, label int")
    d = lambda i, j: (rows[i][1][0] - rows[j][1][0]) ** 2
    for found in (md.margin_triplets(v, v), md.ranked_pairs(v, v).where("same").groupBy("query").agg(F.sum("active").alias("n"), F.sum("excess").alias("loss"))):
        for r in found.collect():
            i = r["query"]
            terms = [1 + d(i, j) - d(i, k) for j in range(6) for k in range(6) if j != i and rows[j][2] == rows[i][2] != rows[k][2]]
            assert r["n"] == sum(t > 0 for t in terms) and np.isclose(r["loss"], sum(t for t in terms if t > 0))


def test_distances_and_neighbours_of_blocks_equal_loops(spark, monkeypatch):
    rng = np.random.default_rng(31)
    x = np.round(1000 + rng.normal(size=(90, 4)), 1)  # far from the origin, with ties
    v = spark.createDataFrame([(i, [float(a) for a in r], 1 if i % 3 else -1) for i, r in enumerate(x)], "subject long, vector array<double>, label int").repartition(3)
    asked = v.where("subject % 4 = 0")
    monkeypatch.setattr(md, "QUERY_NUMBERS", 40)  # several parts
    monkeypatch.setattr(md, "ROW_BLOCK", 16)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    both = md.measures(asked, v, {"a": md.squared_distance, "b": md.poly_kernel}).collect()
    assert len(both) == 23 * 90 and all(np.isclose(r["a"], d[r["query"], r["subject"]]) and np.isclose(r["b"], (1 + x[r["query"]] @ x[r["subject"]]) ** 2) for r in both)
    found = {r["query"]: r["score"] for r in md.knn_score(asked, v, 5).collect()}
    for i in range(0, 90, 4):
        near = [j for j in np.lexsort((np.arange(90), np.round(d[i], 9))) if j != i][:5]
        assert np.isclose(found[i], np.mean([1 if j % 3 else -1 for j in near])) or len(set(np.round(d[i], 9)[near])) < len(near)
