"""Linear fits held against the same fits in SQL: eliminations on the matrix of products, kept as lists of lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from motionmill.jobs.catalog import ids, query, r, rounded, stored
from motionmill.jobs.catalog_models import FOLD_SQL, folds, targets
from motionmill.operators import models as md, refits as rf, sweep as sw
from motionmill.sources import adapters as ad

D = 64  # entries of a vector
VEC = ("vec", "SELECT vec_id AS subject, CASE WHEN label < 5 THEN 1 ELSE -1 END AS label, list_append(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), 1.0::DOUBLE) AS z FROM embeddings")


def products_sql(rows: str, by: str = "", d: int = D + 1, ridge: float = 0.0, extra: str = "") -> str:
    """(by, m, b, pos, neg): the matrix of products as a list of rows, products with balanced targets, sums by class."""
    key = f"{by}, " if by else ""
    on = f"USING ({by})" if by else "ON true"
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {key}m, list_transform(range(1, {d} + 1), lambda i: (2 * nn * pos[i] - 2 * np * neg[i]) / (np + nn)) AS b, pos, neg, np, nn FROM
      (SELECT {key}list(line ORDER BY i) AS m FROM (SELECT {key}i, list(v ORDER BY j) AS line FROM (SELECT {key}i, j, sum(z[i] * z[j]) + CASE WHEN i = j THEN {ridge}::DOUBLE ELSE 0 END AS v
        FROM {rows}, range(1, {d} + 1) x(i), range(1, {d} + 1) y(j) GROUP BY {key}i, j) GROUP BY {key}i) {group}) q
      JOIN (SELECT {key}list(p ORDER BY i) AS pos, list(n ORDER BY i) AS neg, CAST(max(c) AS DOUBLE) AS np, CAST(max(e) AS DOUBLE) AS nn FROM (SELECT {key}i, coalesce(sum(z[i]) FILTER (label = 1), 0.0) AS p, coalesce(sum(z[i]) FILTER (label <> 1), 0.0) AS n,
        count(*) FILTER (label = 1) AS c, count(*) FILTER (label <> 1) AS e FROM {rows}, range(1, {d} + 1) x(i) GROUP BY {key}i) {group}) s {on}"""


def swept(m: str, k: str) -> str:
    """Matrix ``m`` with column ``k`` cleared, a step of Gauss-Jordan elimination."""
    return f"list_transform({m}, lambda line, i: CASE WHEN i = {k} THEN list_transform(line, lambda x: x / {m}[{k}][{k}]) ELSE list_transform(line, lambda x, j: x - line[{k}] / {m}[{k}][{k}] * {m}[{k}][j]) END)"


def solved(d: int) -> str:
    """(m, b) as a matrix with b behind it, all columns cleared: the last entry of each row is the solution."""
    whole = f"list_transform(m, lambda line, i: list_append(line, b[i]))"
    steps = f"list_transform(range(1, {d} + 1), lambda k: [[CAST(k AS DOUBLE)]])"
    return f"list_transform(list_reduce(list_prepend({whole}, {steps}), lambda a, k: {swept('a', 'CAST(k[1][1] AS INT)')}), lambda line: line[{d} + 1])"


def inverse(d: int) -> str:
    """The inverse of m."""
    whole = f"list_transform(m, lambda line, i: list_concat(line, list_transform(range(1, {d} + 1), lambda j: CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)))"
    steps = f"list_transform(range(1, {d} + 1), lambda k: [[CAST(k AS DOUBLE)]])"
    return f"list_transform(list_reduce(list_prepend({whole}, {steps}), lambda a, k: {swept('a', 'CAST(k[1][1] AS INT)')}), lambda line: line[{d} + 1:])"


def dot(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b})"


SUMS = ("sums_t", products_sql("vec", ridge=0.1))


def every(spark, d) -> rf.Sums:
    return rf.total(rf.class_sums(ad.vectors(spark, d)))


def scored(spark, d, w) -> DataFrame:
    return rounded(md.linear_score(ad.vectors(spark, d).withColumn("vector", F.concat("vector", F.array(F.lit(1.0)))), w), "score")


@query("least_squares", f"SELECT subject, label, round({dot('w', 'z')}, 6) + 0.0 AS score FROM vec, (SELECT {solved(D + 1)} AS w FROM sums_t)", VEC, SUMS)
def least_squares(spark, d):
    v = targets(ad.vectors(spark, d).withColumn("vector", F.concat("vector", F.array(F.lit(1.0)))))
    return rounded(md.linear_score(v, md.least_squares(v, "target", 0.1)), "score")


#: Rows of the matrix, each with its product with the targets and whether it is chosen; the next is the largest product not chosen.
GREEDY = f"list_transform([list_transform(a, lambda line: CASE WHEN line[{D + 2}] = 1 THEN -1.0::DOUBLE ELSE abs(line[{D + 1}]) END)], lambda size: list_position(size, list_max(size)))[1]"
MARKED = f"list_transform([{GREEDY}], lambda k: list_transform({swept('a', 'k')}, lambda line, i: list_append(line[1:{D + 1}], CASE WHEN i = k THEN 1.0::DOUBLE ELSE a[i][{D + 2}] END)))[1]"
PURSUED = f"""SELECT list_reduce(list_prepend(list_transform(m, lambda line, i: list_append(list_append(line, b[i]), 0.0::DOUBLE)), list_transform(range(8), lambda k: [[0.0::DOUBLE]])), lambda a, k: {MARKED}) AS a FROM sums_64"""


@query(
    "matching_pursuit",
    f"SELECT subject, label, round({dot(f'list_transform(a, lambda line: CASE WHEN line[{D + 2}] = 1 THEN line[{D + 1}] ELSE 0.0 END)', f'z[1:{D}]')}, 6) + 0.0 AS score FROM vec, pursued",
    VEC, ("sums_64", products_sql("vec", d=D)), ("pursued", PURSUED),
)
def matching_pursuit(spark, d):
    v = targets(ad.vectors(spark, d))
    features, w = md.matching_pursuit(v, "target", 8)
    return rounded(md.linear_score(md.pick(v, features), w), "score")


def dropped(n: int, keep: int) -> list[int]:
    """1 where weights are taken anew, 0 else, for every feature that goes."""
    out = []
    while n > keep:
        k = min(n - keep, int(0.05 * n + 1))
        out += [1] + [0] * (k - 1)
        n -= k
    return out


KEEP = 20
#: Rows of the inverse, each with its weight and whether it is left. First the weights, where they are due; then the least one goes.
FRESH = f"list_transform(a, lambda line, i: CASE WHEN e[1][1] = 1 THEN list_concat(line[1:{D}], [{dot(f'line[1:{D}]', 'b')}, line[{D + 2}]]) ELSE line END)"
LEAST = f"list_transform([list_transform(f, lambda line: CASE WHEN line[{D + 2}] = 1 THEN abs(line[{D + 1}]) ELSE 1e300::DOUBLE END)], lambda size: list_position(size, list_min(size)))[1]"
GONE = f"list_transform([{LEAST}], lambda k: list_transform(f, lambda line, i: list_transform(line, lambda x, j: CASE WHEN j <= {D} THEN x - line[k] * f[k][j] / f[k][k] WHEN j = {D + 2} AND i = k THEN 0.0::DOUBLE ELSE x END)))[1]"
STEPS = "[" + ", ".join(f"[[{x}.0::DOUBLE]]" for x in dropped(D, KEEP)) + "]"
LEFT = f"""SELECT list_reduce(list_prepend(list_transform({inverse(D)}, lambda line: list_concat(line, [0.0::DOUBLE, 1.0::DOUBLE])), {STEPS}), lambda a, e: list_transform([{FRESH}], lambda f: {GONE})[1]) AS a FROM sums_64r"""


@query(
    "eliminate_features",
    f"SELECT CAST(i - 1 AS BIGINT) AS feature_id FROM left_t, range(1, {D} + 1) g(i) WHERE a[i][{D + 2}] = 1",
    VEC, ("sums_64r", products_sql("vec", d=D, ridge=0.1)), ("left_t", LEFT),
)
def eliminate_features(spark, d):
    import numpy as np

    v = targets(ad.vectors(spark, d))
    xx, xy, _ = md.gram(v, ["target"])
    fit = lambda f: np.linalg.lstsq(xx[np.ix_(f, f)] + 0.1 * np.eye(len(f)), xy[f, 0], rcond=None)[0]
    kept = md.eliminate_features(fit, list(range(len(xx))), KEEP)
    return spark.createDataFrame([(int(f),) for f in kept], "feature_id long")


def lasso_sql(gamma: float, sweeps: int = 60) -> str:
    """Coordinate descent; the state is what is left of the products, then the weights."""
    n, d = "(np + nn)", D + 1
    pull = f"(s[k[1]] + m[k[1]][k[1]] / {n} * s[{d} + k[1]])"
    new = f"sign({pull}) * greatest(abs({pull}) - CASE WHEN k[1] < {d} THEN {gamma}::DOUBLE ELSE 0 END, 0) / (m[k[1]][k[1]] / {n})"
    step = f"list_transform([{new} - s[{d} + k[1]]], lambda t: list_transform(s, lambda x, j: CASE WHEN j <= {d} THEN x - t * m[k[1]][j] / {n} WHEN j = {d} + k[1] THEN x + t ELSE x END))[1]"
    begin = f"list_concat(list_transform(b, lambda x: x / {n}), list_transform(b, lambda x: 0.0::DOUBLE))"
    steps = f"list_transform(range({sweeps} * {d}), lambda q: [CAST(q % {d} + 1 AS DOUBLE)])"
    return f"SELECT list_reduce(list_prepend({begin}, {steps}), lambda s, k: {step.replace('k[1]', 'CAST(k[1] AS INT)')})[{d + 1}:] AS w, m, b FROM sums_0"


SUMS_0 = ("sums_0", products_sql("vec"))


@query("lasso", f"SELECT subject, label, round({dot('w', 'z')}, 6) + 0.0 AS score FROM vec, lassoed", VEC, SUMS_0, ("lassoed", lasso_sql(0.004)))
def lasso(spark, d):
    return scored(spark, d, rf.lasso(every(spark, d), 0.004))


USED = f"list_transform(w, lambda x, i: i = {D + 1} OR abs(x) > 0.1 * list_max(list_transform(w[1:{D}], lambda y: abs(y))))"
AGAIN = f"""SELECT list_transform(m, lambda line, i: list_transform(line, lambda x, j: CASE WHEN u[i] AND u[j] THEN x + CASE WHEN i = j THEN 0.1::DOUBLE ELSE 0 END WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS m,
  list_transform(b, lambda x, i: CASE WHEN u[i] THEN x ELSE 0.0::DOUBLE END) AS b FROM (SELECT m, b, {USED} AS u FROM lassoed)"""


@query(
    "sparse_classifier", f"SELECT subject, label, round({dot('w', 'z')}, 6) + 0.0 AS score FROM vec, (SELECT {solved(D + 1)} AS w FROM again)",
    VEC, SUMS_0, ("lassoed", lasso_sql(0.004)), ("again", AGAIN),
)
def sparse_classifier(spark, d):
    """The lasso's features, fitted again by ridge."""
    return scored(spark, d, rf.sparse(every(spark, d), 0.004))


OUTSIDE = ("kept_f", "SELECT v.*, k FROM vec v JOIN fold_t f USING (subject), range(4) g(k) WHERE k <> fold")


@query(
    "ridge_in_folds",
    f"SELECT CAST(k AS BIGINT) AS fold, v.subject, v.label, round({dot('w', 'z')}, 6) + 0.0 AS score FROM vec v JOIN fold_t f ON f.subject = v.subject JOIN (SELECT k, {solved(D + 1)} AS w FROM sums_f) s ON s.k = f.fold",
    VEC, ("fold_t", FOLD_SQL), OUTSIDE, ("sums_f", products_sql("kept_f", "k", ridge=0.1)),
)
def ridge_in_folds(spark, d):
    """Rows scored by the ridge fit of all rows outside their fold."""
    out = rf.cross_evaluate(ad.vectors(spark, d), stored(spark, lambda: folds(spark, d)), [("ridge", "gamma", 0.1)])
    return rounded(out.select("fold", "subject", "label", "score"), "score")


LEFT_OUT = f"""SELECT subject, label, CASE WHEN label = 1 THEN 2 * nn * (p - a) - 2 * (np - 1) * q ELSE 2 * (nn - 1) * p - 2 * np * (q - a) END / (np + nn - 1) / (1 - a) AS score FROM (
  SELECT subject, label, np, nn, {dot('z', 'y')} AS a, {dot('y', 'pos')} AS p, {dot('y', 'neg')} AS q FROM (SELECT *, list_transform(inv, lambda line: {dot('line', 'z')}) AS y FROM vec, (SELECT {inverse(D + 1)} AS inv, pos, neg, np, nn FROM sums_t)))"""


@query("leave_one_out", f"SELECT subject, label, {r('score')} FROM ({LEFT_OUT})", VEC, SUMS)
def leave_one_out(spark, d):
    """Every row scored by the ridge fit of all others."""
    return rounded(rf.leave_one_out(ad.vectors(spark, d), [("ridge", "gamma", 0.1)]).select("subject", "label", "score"), "score")


PAIR_WON = f"""SELECT pos, neg, {dot('w', 'x')} AS s_pos, {dot('w', 'y')} AS s_neg FROM (SELECT k AS pair, {solved(D + 1)} AS w FROM sums_p) JOIN pairs_t USING (pair)"""


@query(
    "ridge_pair_refits",
    f"SELECT pos, neg, {r('s_pos', 's_neg')} FROM ({PAIR_WON})",
    VEC, ("pairs_t", "SELECT p.subject AS pos, q.subject AS neg, row_number() OVER (ORDER BY p.subject) AS pair, p.z AS x, q.z AS y FROM vec p JOIN vec q ON q.subject = p.subject + 7 WHERE p.label = 1 AND q.label <> 1 AND p.subject % 20 = 0"),
    ("kept_p", "SELECT v.*, pair AS k FROM vec v, pairs_t WHERE v.subject <> pos AND v.subject <> neg"), ("sums_p", products_sql("kept_p", "k", ridge=0.1)),
)
def ridge_pair_refits(spark, d):
    """Pairs of a positive, of those whose id is divisible by 20, and the negative seven ids on, scored by fits on all others."""
    rows = ids(spark, d)
    pos = rows.where((F.col("label") == 1) & (F.col("subject") % 20 == 0)).select(F.col("subject").alias("pos"), (F.col("subject") + 7).alias("neg"))
    pairs = pos.join(rows.where("label <> 1").select(F.col("subject").alias("neg")), "neg").select("pos", "neg")
    out = rf.pair_refits(ad.vectors(spark, d), pairs, [("ridge", "gamma", 0.1)])
    return rounded(out.select("pos", "neg", "s_pos", "s_neg"), "s_pos", "s_neg")


#: A matrix squared again and again, over its trace, is left with its largest axis alone; taken away, the next one is the largest.
SQUARED = "list_reduce(list_prepend(m, list_transform(range(18), lambda q: [[0.0::DOUBLE]])), lambda a, q: list_transform([list_sum(list_transform(a, lambda line, i: line[i]))], lambda t: list_transform(a, lambda x: list_transform(a, lambda y: list_inner_product(x, y) / (t * t))))[1])"


def axis_ctes() -> tuple:
    out, source = [], "sums_64"
    for k in range(1, 4):
        longest = "list_transform([list_transform(s, lambda line, i: line[i])], lambda d: s[list_position(d, list_max(d))])[1]"
        signed = "list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)) * sign(v[list_position(list_transform(v, lambda y: abs(y)), list_max(list_transform(v, lambda y: abs(y))))]))"
        out.append((f"axis{k}", f"SELECT m, {signed} AS v FROM (SELECT m, {longest} AS v FROM (SELECT m, {SQUARED} AS s FROM {source}))"))
        value = "list_inner_product(v, list_transform(m, lambda line: list_inner_product(line, v)))"
        out.append((f"rest{k}", f"SELECT list_transform(m, lambda line, i: list_transform(line, lambda x, j: x - {value} * v[i] * v[j])) AS m FROM axis{k}"))
        source = f"rest{k}"
    return tuple(out[:-1])


@query(
    "pca",
    "SELECT subject, " + ", ".join(f"round({dot(f'axis{k}.v', f'z[1:{D}]')}, 5) + 0.0 AS p{k}" for k in (1, 2, 3)) + " FROM vec, axis1, axis2, axis3",
    VEC, ("sums_64", products_sql("vec", d=D)), *axis_ctes(),
)
def pca(spark, d):
    _, shown = md.pca(ad.vectors(spark, d), 3)
    return shown.select("subject", *[(F.round(F.col("projected")[k - 1], 5) + 0.0).alias(f"p{k}") for k in (1, 2, 3)])


GAMMA = 0.01
#: The products of each class weighted by its size bound the curvature; steps with its inverse, for each fold.
BOUND = f"""SELECT k, list(line ORDER BY i) AS m FROM (SELECT k, i, list(v ORDER BY j) AS line FROM (SELECT k, i, j, sum(z[i] * z[j] / n) + CASE WHEN i = j AND i <= {D} THEN {GAMMA}::DOUBLE ELSE 0 END AS v
  FROM (SELECT *, count(*) OVER (PARTITION BY k, label) AS n FROM kept_f), range(1, {D + 2}) x(i), range(1, {D + 2}) y(j) GROUP BY k, i, j) GROUP BY k, i) GROUP BY k"""
ROWS_F = """SELECT k, list(z ORDER BY subject) AS zs, list(CAST(label AS DOUBLE) ORDER BY subject) AS ys, list(1.0::DOUBLE / n ORDER BY subject) AS cs FROM (SELECT *, count(*) OVER (PARTITION BY k, label) AS n FROM kept_f) GROUP BY k"""
COLUMNS_F = f"SELECT k, zs, ys, cs, inv, list_transform(range(1, {D + 2}), lambda j: list_transform(zs, lambda z: z[j])) AS columns FROM rows_f JOIN (SELECT k, {inverse(D + 1)} AS inv FROM bound_f) USING (k)"
SHORT = f"list_transform(zs, lambda z, i: ys[i] * cs[i] * greatest(1 - ys[i] * {dot('z', 'w')}, 0))"
SLOPE = f"list_transform([{SHORT}], lambda s: list_transform(columns, lambda c, j: CASE WHEN j <= {D} THEN {GAMMA} * w[j] ELSE 0 END - {dot('c', 's')}))[1]"
MACHINE = f"""SELECT k, list_reduce(list_prepend(list_transform(columns, lambda c: 0.0::DOUBLE), list_transform(range(300), lambda q: [0.0::DOUBLE])), lambda w, q: list_transform([{SLOPE}], lambda g: list_transform(w, lambda x, i: x - {dot('inv[i]', 'g')}))[1]) AS w FROM columns_f"""


@query(
    "svm_in_folds",
    f"SELECT CAST(k AS BIGINT) AS fold, v.subject, v.label, round({dot('w', 'z')}, 5) + 0.0 AS score FROM vec v JOIN fold_t f ON f.subject = v.subject JOIN machine_f s ON s.k = f.fold",
    VEC, ("fold_t", FOLD_SQL), OUTSIDE, ("bound_f", BOUND), ("rows_f", ROWS_F), ("columns_f", COLUMNS_F), ("machine_f", MACHINE),
)
def svm_in_folds(spark, d):
    """Rows scored by the machine of all rows outside their fold."""
    v, of = ad.vectors(spark, d), stored(spark, lambda: folds(spark, d).select("subject", F.col("fold").cast("long").alias("out")))
    fitted = sw.svm_weights(v, of, [GAMMA], tol=1e-9)
    table = [("svm", "gamma", o, [float(x) for x in w]) for (o, _), w in fitted.items()]
    out = rf.weight_scores(v.join(of, "subject"), table, "out").select(F.col("out").alias("fold"), "subject", "label", F.round("score", 5).alias("score"))
    return out.withColumn("score", F.col("score") + 0.0)
