"""Evaluation by refits: classifiers fitted again with a fold, a subject or a pair of subjects left out.

Linear classifiers on balanced targets need no more than sums of products by class. These are summed once, by fold, on
Spark; what is left out is subtracted, and each fit works on d x d numbers. Scores are then expressions on the rows, or,
where every row or pair has a fit of its own, numpy on batches of rows. Neighbours meet in blocks, densities in sums by
feature, class and fold. No design is collected or broadcast.

Folds: (subject, fold). Vectors: (subject, vector, label), labels 1 and -1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from motionmill.operators import design as dz, evaluate as ev, leave_out as lo
from motionmill.operators.models import _dot, check_width, eliminate_features, gram_pursuit

#: Rows of a block of neighbours.
BLOCK = 1024


@dataclass
class Sums:
    """Sums over training rows, each with a constant 1 as last entry: products, sums by class, rows by class."""

    xx: np.ndarray
    pos: np.ndarray
    neg: np.ndarray
    n_pos: float
    n_neg: float

    def less(self, other: Sums) -> Sums:
        return Sums(self.xx - other.xx, self.pos - other.pos, self.neg - other.neg, self.n_pos - other.n_pos, self.n_neg - other.n_neg)

    def less_row(self, x: np.ndarray, label: int) -> Sums:
        """``x`` with its constant."""
        one = (1, 0) if label == 1 else (0, 1)
        return self.less(Sums(np.outer(x, x), x * one[0], x * one[1], *one))

    def of(self, columns: list[int]) -> Sums:
        at = [*columns, len(self.pos) - 1]
        return Sums(self.xx[np.ix_(at, at)], self.pos[at], self.neg[at], self.n_pos, self.n_neg)

    @property
    def xy(self) -> np.ndarray:
        """Products with the balanced targets, 2 P(neg) and -2 P(pos)."""
        n = max(self.n_pos + self.n_neg, 1)
        return 2 * self.n_neg / n * self.pos - 2 * self.n_pos / n * self.neg


Fit = Callable[[Sums, float], np.ndarray]


def ridge(s: Sums, gamma: float) -> np.ndarray:
    return np.linalg.solve(s.xx + gamma * np.eye(len(s.xx)), s.xy)


def least_squares(s: Sums, _: float) -> np.ndarray:
    return np.linalg.lstsq(s.xx, s.xy, rcond=None)[0]


def pursuit(s: Sums, m: float) -> np.ndarray:
    out = np.zeros(len(s.xy))
    chosen, w = gram_pursuit(s.xx, s.xy, int(m))
    out[chosen] = w
    return out


def lasso(s: Sums, gamma: float, rounds: int = 200) -> np.ndarray:
    """Coordinate descent on half the mean squared error plus gamma times the size of the weights; the constant is free."""
    n, w = max(s.n_pos + s.n_neg, 1), np.zeros(len(s.xy))
    xx, xy = s.xx / n, s.xy / n
    for _ in range(rounds):
        before = w.copy()
        for k in range(len(w)):
            if xx[k, k] > 0:
                rest = xy[k] - xx[k] @ w + xx[k, k] * w[k]
                w[k] = np.sign(rest) * max(abs(rest) - (gamma if k < len(w) - 1 else 0.0), 0.0) / xx[k, k]
        if np.abs(w - before).max() <= 1e-9:
            break
    return w


def elimination(s: Sums, keep: float, gamma: float = 0.1) -> np.ndarray:
    """Ridge on the ``keep`` features that are left by dropping the smallest weights."""
    last = len(s.xy) - 1
    fit = lambda f: ridge(s.of(f), gamma)[:-1]
    left = eliminate_features(fit, list(range(last)), int(keep))
    out = np.zeros(last + 1)
    out[[*left, last]] = ridge(s.of(left), gamma)
    return out


def sparse(s: Sums, gamma: float, thres: float = 0.1, again: float = 0.1) -> np.ndarray:
    """Ridge on the features whose lasso weight exceeds ``thres`` of the largest; on the constant alone where all weights are 0."""
    size, out = np.abs(lasso(s, gamma)[:-1]), np.zeros(len(s.xy))
    columns = np.flatnonzero(size > thres * size.max()).tolist()
    out[[*columns, len(out) - 1]] = ridge(s.of(columns), again)
    return out


#: The classifiers that need no more than Sums; callers may add their own.
FITS: dict[str, Fit] = {"ridge": ridge, "least_squares": least_squares, "pursuit": pursuit, "lasso": lasso, "elimination": elimination, "sparse": sparse}
Grid = list[tuple[str, str, float]]  # model, parameter's name, value


def _name(parameter: str, value: float) -> str:
    return f"{parameter}={value:g}"


def _fitted(fit: Fit, sums: Sums, value: float, select: Callable[[Sums], list[int]] | None) -> np.ndarray:
    if select is None:
        return fit(sums, value)
    columns, out = select(sums), np.zeros(len(sums.pos))
    out[[*columns, len(out) - 1]] = fit(sums.of(columns), value)
    return out


def class_products(vectors: DataFrame, by: str | None = None) -> dict[tuple[int | None, int], np.ndarray]:
    """Products of (vector, 1) by (value of ``by``, label); the last row holds the sums and the number of rows."""
    check_width(vectors)
    keys = ["label"] if by is None else [by, "label"]
    cells = dz.product_sums(vectors, keys).toPandas()  # d x d for each key, d as checked
    d = int(cells["i"].max()) + 1 if len(cells) else 1
    out = {}
    for key, part in cells.groupby(keys):
        m = np.zeros((d, d))
        m[part["i"], part["j"]] = part["value"]
        out[None if by is None else int(key[0]), 1 if key[-1] == 1 else -1] = m
    return out


def class_sums(vectors: DataFrame, by: str | None = None) -> dict[int | None, Sums]:
    """Sums of each value of ``by``, a few, or of all rows."""
    out: dict[int | None, Sums] = {}
    for (key, label), m in class_products(vectors, by).items():
        d = len(m)
        got = out.setdefault(key, Sums(np.zeros((d, d)), np.zeros(d), np.zeros(d), 0.0, 0.0))
        got.xx += m
        if label == 1:
            got.pos, got.n_pos = m[-1].copy(), m[-1, -1]
        else:
            got.neg, got.n_neg = m[-1].copy(), m[-1, -1]
    return out


def total(sums: dict) -> Sums:
    parts = list(sums.values())
    return Sums(sum(p.xx for p in parts), sum(p.pos for p in parts), sum(p.neg for p in parts), sum(p.n_pos for p in parts), sum(p.n_neg for p in parts))


def best_gaps(n: int) -> Callable[[Sums], list[int]]:
    """Selection of the ``n`` features whose class means lie furthest apart, by their deviation."""

    def select(s: Sums) -> list[int]:
        rows = s.n_pos + s.n_neg
        spread = np.sqrt(np.maximum(np.diag(s.xx) / rows - ((s.pos + s.neg) / rows) ** 2, 1e-12))
        gap = np.abs(s.pos / max(s.n_pos, 1) - s.neg / max(s.n_neg, 1)) / spread
        return sorted(np.argsort(-gap[:-1], kind="stable")[:n].tolist())

    return select


def weight_scores(rows: DataFrame, weights: list[tuple], by: str) -> DataFrame:
    """(model, params, by, subject, label, score) of rows with ``by`` under weights (model, params, by, w), a row for each fit."""
    table = rows.sparkSession.createDataFrame(weights, f"model string, params string, {by} long, w array<double>")
    one = F.concat("vector", F.array(F.lit(1.0)))
    return rows.withColumn(by, F.col(by).cast("long")).join(F.broadcast(table), by).select("model", "params", by, "subject", "label", _dot(one, F.col("w")).alias("score"))


def chosen_columns(chosen: DataFrame) -> dict[int, list[int]]:
    """Features by fold, of (fold, feature_id); as many as vectors have entries, at most."""
    return {r["fold"]: sorted(r["f"]) for r in chosen.groupBy(F.col("fold").cast("long").alias("fold")).agg(F.collect_set(F.col("feature_id").cast("int")).alias("f")).collect()}


def cross_evaluate(
    vectors: DataFrame, folds: DataFrame, grid: Grid, select: Callable[[Sums], list[int]] | None = None, fits: dict[str, Fit] = FITS, chosen: DataFrame | None = None
) -> DataFrame:
    """(model, params, fold, subject, label, score): every classifier of ``grid`` fitted outside each fold, scored inside.

    ``select`` picks features from the sums outside the fold; ``chosen`` (fold, feature_id) names them, as
    ``fold_selection`` does. Weights, one row for each fit, are broadcast.
    """
    rows = vectors.join(folds.select("subject", "fold"), "subject")
    sums = class_sums(rows, "fold")
    every = total(sums)
    named = chosen_columns(chosen) if chosen is not None else {}
    of = lambda k: select if chosen is None else (lambda _: named.get(k, []))
    weights = [(m, _name(p, v), k, [float(x) for x in _fitted(fits[m], every.less(s), v, of(k))]) for m, p, v in grid for k, s in sorted(sums.items())]
    return weight_scores(rows, weights, "fold")


def fold_scores(predicted: DataFrame, measure: Callable[[DataFrame, list[str]], DataFrame] = ev.auc) -> DataFrame:
    """(model, params, fold, score): the measure of each fold, by default the area under the curve."""
    by = ["model", "params", "fold"]
    scored = measure(predicted, by)
    return scored.withColumnRenamed(next(c for c in scored.columns if c not in by), "score")


def _batched(sums: Sums, x: np.ndarray, y: np.ndarray, grid: Grid, fits: dict[str, Fit]) -> Iterator[tuple[str, str, np.ndarray]]:
    """(model, params, weights of every set) with the rows ``x`` (R, m, d), labels ``y``, left out."""
    own = {m: f for m, f in fits.items() if f is not FITS.get(m) or m not in lo.BATCHES}
    for m, p, v in grid:
        yield m, _name(p, v), lo.weights(sums, x, y, m, v, own)


def _with_one(vectors: pd.Series) -> np.ndarray:
    return np.c_[np.stack(vectors.tolist()), np.ones(len(vectors))]


def leave_one_out(vectors: DataFrame, grid: Grid, fits: dict[str, Fit] = FITS) -> DataFrame:
    """(model, params, subject, label, score): each row scored by a fit on all others, from sums lowered by the row."""
    sent = vectors.sparkSession.sparkContext.broadcast(total(class_sums(vectors)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, y = _with_one(b["vector"]), b["label"].to_numpy()
                for m, p, w in _batched(sent.value, x[:, None], np.where(y == 1, 1, -1)[:, None], grid, fits):
                    yield pd.DataFrame({"model": m, "params": p, "subject": b["subject"], "label": y, "score": (w * x).sum(axis=1)})

    return vectors.select("subject", "label", "vector").mapInPandas(run, "model string, params string, subject long, label int, score double")


def pair_refits(vectors: DataFrame, pairs: DataFrame, grid: Grid, fits: dict[str, Fit] = FITS) -> DataFrame:
    """(model, params, pos, neg, s_pos, s_neg): the two rows of each pair scored by a fit on all others."""
    sent = vectors.sparkSession.sparkContext.broadcast(total(class_sums(vectors)))
    side = lambda of, name: vectors.select(F.col("subject").alias(of), F.col("vector").alias(name))
    met = pairs.join(side("pos", "x"), "pos").join(side("neg", "y"), "neg").select("pos", "neg", "x", "y")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack((_with_one(b["x"]), _with_one(b["y"])), axis=1)
                for m, p, w in _batched(sent.value, x, np.tile([1, -1], (len(b), 1)), grid, fits):
                    s = np.einsum("rmd,rd->rm", x, w)
                    yield pd.DataFrame({"model": m, "params": p, "pos": b["pos"], "neg": b["neg"], "s_pos": s[:, 0], "s_neg": s[:, 1]})

    return met.mapInPandas(run, "model string, params string, pos long, neg long, s_pos double, s_neg double")


NEAREST = T.ArrayType(T.StructType([T.StructField("query", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("subject", T.LongType()), T.StructField("label", T.IntegerType())]))


def _nearest_of_blocks(k: int):
    @F.pandas_udf(NEAREST)
    def nearest(queries: pd.Series, rows: pd.Series) -> pd.Series:
        out = []
        for q, r in zip(queries, rows):
            x, y = np.stack([a["vector"] for a in q]), np.stack([a["vector"] for a in r])
            fold, who = np.array([a["fold"] for a in r]), np.array([a["subject"] for a in r])
            label = [a["label"] for a in r]
            found = []
            for a, line in zip(q, ((x[:, None] - y[None]) ** 2).sum(axis=2) if x.size * len(y) < 1 << 22 else (((v - y) ** 2).sum(axis=1) for v in x)):
                line = np.where(fold == a["fold"], np.inf, line)
                best = np.lexsort((who, line))[:k]
                found += [(a["subject"], float(line[i]), int(who[i]), int(label[i])) for i in best if np.isfinite(line[i])]
            out.append(found)
        return pd.Series(out)

    return nearest


#: Cells of the space at most, rings that a cell is cut into, and numbers of the sample that bounds every search.
MAX_PIVOTS, RINGS, SAMPLE_NUMBERS = 1024, 8, 1 << 18


@dataclass
class Cells:
    """Pivots, and of each pivot's cell the edges of its rings (distances to the pivot) and the parts that a ring is dealt into."""

    pivots: np.ndarray
    edges: dict[int, np.ndarray]
    parts: dict[int, int]

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ self.pivots.T + (self.pivots * self.pivots).sum(axis=1), 0))

    def needed(self, d: np.ndarray, reach: float) -> list[tuple[int, int, int]]:
        """(cell, ring, parts) that may hold a row within ``reach`` of a point at distances ``d`` from the pivots."""
        out = []
        for c, edges in self.edges.items():  # |d - r| bounds the distance to a row at r from the pivot
            near = np.flatnonzero((d[c] - edges[1:] <= reach) & (edges[:-1] - d[c] <= reach))
            out += [(c, int(i), self.parts[c]) for i in near]
        return out


def _in_cells(rows: DataFrame, n: int) -> tuple[DataFrame, Cells]:
    """``rows`` with cell (the nearest pivot) and r (its distance), and the cells; one pivot for about ``BLOCK`` rows."""
    count = int(max(1, min(MAX_PIVOTS, n // BLOCK)))
    first = rows.select("vector", F.xxhash64("subject").alias("h")).orderBy("h").limit(count).collect()
    cells = Cells(np.array([r["vector"] for r in first], float), {}, {})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                d = cells.distances(np.stack(b["vector"].tolist()))
                yield b.assign(cell=d.argmin(axis=1), r=d.min(axis=1))

    placed = rows.mapInPandas(place, "subject long, fold long, label int, vector array<double>, cell int, r double").persist()
    levels = [i / RINGS for i in range(1, RINGS)]
    told = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi"), F.array_distinct(F.percentile_approx("r", levels)).alias("inner"))
    for c in told.collect():  # a row for each pivot
        cut = c["n"] > BLOCK
        inner = [e for e in c["inner"] if c["lo"] < e < c["hi"]] if cut else []
        cells.edges[c["cell"]] = np.array([c["lo"], *inner, c["hi"]])
        cells.parts[c["cell"]] = max(1, -(-c["n"] // (BLOCK * (len(inner) + 1))))
    return placed, cells


def _searches(placed: DataFrame, cells: Cells, k: int) -> DataFrame:
    """``placed`` with its ring, and ``asked``: the rings that may hold one of the k nearest rows of other folds.

    The k nearest of a bounded sample are an upper bound of how far one has to look.
    """
    spark = placed.sparkSession
    many = max(16, SAMPLE_NUMBERS // max(cells.pivots.shape[1], 1)) if cells.pivots.ndim == 2 else 16
    some = placed.select("subject", "fold", "vector", F.xxhash64("subject", F.lit(1)).alias("h")).orderBy("h").limit(many).collect()
    sent = spark.sparkContext.broadcast((np.array([r["vector"] for r in some], float), np.array([r["fold"] for r in some]), cells))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample, fold, cells = sent.value
        size = (sample * sample).sum(axis=1)
        for b in batches:
            if not len(b):
                continue
            x, asked = np.stack(b["vector"].tolist()), []
            own = cells.distances(x)
            d = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ sample.T + size, 0))
            d[b["fold"].to_numpy()[:, None] == fold[None]] = np.inf
            reach = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(b), np.inf)
            for line, far in zip(own, reach):
                asked.append([{"cell": c, "ring": i, "parts": p} for c, i, p in cells.needed(line, far * (1 + 1e-9) + 1e-6)])
            ring = [int(np.clip(np.searchsorted(cells.edges[c], r, side="left") - 1, 0, len(cells.edges[c]) - 2)) for c, r in zip(b["cell"], b["r"])]
            yield b.assign(ring=ring, parts=[cells.parts[c] for c in b["cell"]], asked=asked)[["subject", "fold", "label", "vector", "cell", "ring", "parts", "asked"]]

    kinds = "subject long, fold long, label int, vector array<double>, cell int, ring int, parts int, asked array<struct<cell:int,ring:int,parts:int>>"
    return placed.mapInPandas(search, kinds)


def neighbours_in_folds(vectors: DataFrame, folds: DataFrame, ks: list[int]) -> DataFrame:
    """(model, params, fold, subject, label, score): mean label of the k nearest rows of other folds, ties to the lower id.

    Rows are dealt into cells around pivots, cells into rings by the distance to the pivot. By the triangle inequality a
    row asks only the rings that may hold one of its nearest; blocks of rows meet ring by ring and hand on their k
    nearest. Exact whatever the data; how much is spared depends on how far they cluster.
    """
    most = max(ks)
    rows = vectors.join(folds.select("subject", F.col("fold").cast("long").alias("fold")), "subject").select("subject", "fold", "label", "vector").persist()
    n = rows.count()
    if not n:
        return rows.select(F.lit("knn").alias("model"), F.lit("").alias("params"), "fold", "subject", "label", F.lit(0.0).alias("score"))
    placed, cells = _in_cells(rows, n)
    asks = _searches(placed, cells, most).persist()
    entry = F.struct("subject", "fold", "label", "vector")
    part = F.pmod(F.xxhash64("subject", F.lit(2)), F.col("parts")).cast("int")
    held = asks.withColumn("part", part).groupBy("cell", "ring", "part").agg(F.collect_list(entry).alias("rows"))
    block = F.pmod(F.xxhash64("subject"), F.lit(-(-n // BLOCK))).cast("int")
    each = asks.select(entry.alias("e"), block.alias("block"), F.explode("asked").alias("a")).select("e", "block", "a.cell", "a.ring", F.explode(F.sequence(F.lit(0), F.col("a.parts") - 1)).alias("part"))
    asked = each.groupBy("cell", "ring", "part", "block").agg(F.collect_list("e").alias("queries"))
    near = asked.join(held, ["cell", "ring", "part"]).select(F.inline(_nearest_of_blocks(most)("queries", "rows")))
    ranked = near.withColumn("rn", F.row_number().over(W.partitionBy("query").orderBy("d", "subject"))).where(F.col("rn") <= most)
    means = ranked.groupBy("query").agg(*[F.avg(F.when(F.col("rn") <= k, F.col("label"))).alias(f"k{k}") for k in ks])
    each = F.explode(F.array(*[F.struct(F.lit(_name("k", k)).alias("params"), F.col(f"k{k}").alias("score")) for k in ks]))
    scored = means.select(F.col("query").alias("subject"), each.alias("s")).select("subject", "s.*")
    return rows.select("fold", "subject", "label").join(scored, "subject").select(F.lit("knn").alias("model"), "params", "fold", "subject", "label", "score")


# ---------------------------------------------------------------- detection on densities


def gap_features(values: DataFrame, top: int) -> DataFrame:
    """(fold, feature_id): the ``top`` features whose class means lie furthest apart, by their deviation, outside each fold.

    ``values``: subject, feature_id, value, label, fold.
    """
    pos = F.col("label") == 1
    own = values.groupBy("feature_id", "fold").agg(
        F.count(F.when(pos, 1)).alias("n1"), F.count(F.when(~pos, 1)).alias("n0"), F.coalesce(F.sum(F.when(pos, F.col("value"))), F.lit(0.0)).alias("s1"),
        F.coalesce(F.sum(F.when(~pos, F.col("value"))), F.lit(0.0)).alias("s0"), F.sum(F.col("value") * F.col("value")).alias("q"),
    )
    every = W.partitionBy("feature_id")
    rest = own.select("feature_id", "fold", *[(F.sum(c).over(every) - F.col(c)).alias(c) for c in ("n1", "n0", "s1", "s0", "q")])
    n, s = F.col("n1") + F.col("n0"), F.col("s1") + F.col("s0")
    spread = F.sqrt(F.col("q") / n - (s / n) * (s / n))
    gap = F.abs(F.col("s1") / F.col("n1") - F.col("s0") / F.col("n0")) / F.when(spread > 0, spread)
    order = W.partitionBy("fold").orderBy(F.desc("gap"), "feature_id")
    return rest.withColumn("gap", F.round(gap, 9)).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= top).select("fold", "feature_id")


def detect_in_folds(densities: DataFrame, chosen: DataFrame, phi: Callable[[Column], Column], psi: Callable[[Column], Column]) -> DataFrame:
    """(fold, subject, label, score): weights from the densities outside each fold, on its chosen features; scores inside.

    ``densities``: subject, feature_id, density, label, fold; ``chosen``: fold, feature_id.
    """
    pos, x = F.col("label") == 1, phi(F.col("density"))
    own = densities.groupBy("feature_id", "fold").agg(
        F.count(F.when(pos, 1)).alias("n1"), F.count(F.when(~pos, 1)).alias("n0"), F.coalesce(F.sum(F.when(pos, x)), F.lit(0.0)).alias("s1"), F.coalesce(F.sum(F.when(~pos, x)), F.lit(0.0)).alias("s0")
    )
    every = W.partitionBy("feature_id")
    rest = own.select("feature_id", "fold", *[(F.sum(c).over(every) - F.col(c)).alias(c) for c in ("n1", "n0", "s1", "s0")])
    weight = F.log(F.col("s1") / F.col("n1")) - F.log(F.col("s0") / F.col("n0"))
    weights = rest.join(chosen, ["fold", "feature_id"]).select("fold", "feature_id", weight.alias("weight"))
    return densities.join(weights, ["fold", "feature_id"]).groupBy("fold", "subject").agg(F.first("label").alias("label"), F.avg(psi(F.col("density")) * F.col("weight")).alias("score"))


def detect_pairs(densities: DataFrame, pairs: DataFrame, phi: Callable[[Column], Column], psi: Callable[[Column], Column]) -> DataFrame:
    """(pos, neg, s_pos, s_neg): both scored by weights from the densities of all others."""
    pos, x = F.col("label") == 1, phi(F.col("density"))
    sums = densities.groupBy("feature_id").agg(F.count(F.when(pos, 1)).alias("n1"), F.count(F.when(~pos, 1)).alias("n0"), F.sum(F.when(pos, x)).alias("s1"), F.sum(F.when(~pos, x)).alias("s0"))
    side = lambda of, name: densities.select(F.col("subject").alias(of), "feature_id", F.col("density").alias(name))
    met = pairs.join(side("pos", "a"), "pos").join(side("neg", "b"), ["neg", "feature_id"]).join(sums, "feature_id")
    weight = F.log((F.col("s1") - phi(F.col("a"))) / (F.col("n1") - 1)) - F.log((F.col("s0") - phi(F.col("b"))) / (F.col("n0") - 1))
    return met.withColumn("weight", weight).groupBy("pos", "neg").agg(F.avg(psi(F.col("a")) * F.col("weight")).alias("s_pos"), F.avg(psi(F.col("b")) * F.col("weight")).alias("s_neg"))


def best_settings(predicted: DataFrame, pairs: DataFrame, keep: float = 0.8) -> DataFrame:
    """(model, params, auc, accuracy, ties, score) of predictions by fold and of pairs: each model's setting with the best score.

    Settings need a mean fold area above ``keep``. Score: accuracy over the pairs without ties, times the share of pairs
    without ties, plus the mean area; ties to the first name.
    """
    means = fold_scores(predicted).groupBy("model", "params").agg(F.avg("score").alias("auc"))
    told = ev.pair_results(pairs, ["model", "params"])
    score = F.col("accuracy") * (1 - F.col("ties")) + F.col("auc")
    both = means.where(F.col("auc") > keep).join(told, ["model", "params"]).withColumn("score", score)
    order = W.partitionBy("model").orderBy(F.desc(F.round("score", 9)), "params")
    return both.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")
