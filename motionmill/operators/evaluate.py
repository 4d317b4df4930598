"""Splits, folds and scores of binary classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Rows of a group that one window takes; larger groups are cut into ranges of about half as many, this many ranges at most.
ROWS, MAX_RANGES = 1_000_000, 4096
#: A fixed shuffled order has so many places; ids that share one follow each other.
HASHES = 10007


def order_hash(key: str = "subject", seed: int = 0) -> Column:
    """A fixed shuffled order."""
    return (F.col(key) * 7919 + seed) % HASHES


def running(df: DataFrame, by: list[str], value: str, tie: str, sums: dict[str, Column], descending: bool = False, previous: str | None = None, rows: int | None = None) -> DataFrame:
    """``df`` with running sums over each group's rows by ``value``, then ``tie``, and with the groups' totals as ``all_<name>``.

    Where no group has more than ``rows`` rows, one window does it. Else groups are cut into ranges at approximate
    quantiles, a mergeable sketch, as many as the largest group asks for; a value at which a cut falls is a range of its
    own, and where many rows share it that range is cut by ``tie``. Rows are summed within a range, and what the ranges
    before add is joined on. So no window holds a large group or a value that many share.
    ``previous`` names a column for the value of the row before. Null values come first, or last when descending.
    """
    rows = ROWS if rows is None else rows
    one = df.withColumn("_one", F.lit(0)) if not by else df
    keys = list(by) or ["_one"]
    most = one.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    order = [F.desc(value), F.desc(tie)] if descending else [F.asc(value), F.asc(tie)]
    kept = [*df.columns, *sums, *([previous] if previous else []), *[f"all_{n}" for n in sums]]
    if most <= rows:
        group = W.partitionBy(*keys)
        line = group.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        placed = one.withColumns({f"_of_{n}": c for n, c in sums.items()})
        return placed.withColumns(
            {n: F.sum(f"_of_{n}").over(line) for n in sums} | {f"all_{n}": F.sum(f"_of_{n}").over(group) for n in sums}
            | ({previous: F.lag(value).over(group.orderBy(*order))} if previous else {})).select(*kept)

    placed = _ranged(one.withColumns({f"_of_{n}": c for n, c in sums.items()}), keys, value, tie, min(MAX_RANGES, -(-2 * most // rows)), rows)
    cells = [*keys, "_range", "_part"]
    totals = placed.groupBy(*cells).agg(*[F.sum(f"_of_{n}").alias(f"_sum_{n}") for n in sums], F.max(value).alias("_last"), F.min(value).alias("_first"))
    step = [F.desc(c) if descending else F.asc(c) for c in ("_range", "_part")]
    upto, every = W.partitionBy(*keys).orderBy(*step).rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*keys)
    before = {f"_before_{n}": F.coalesce(F.sum(f"_sum_{n}").over(upto), F.lit(0)) for n in sums} | {f"all_{n}": F.sum(f"_sum_{n}").over(every) for n in sums}
    edge = F.lag("_first" if descending else "_last").over(W.partitionBy(*keys).orderBy(*step))
    table = totals.withColumns(before | {"_edge": edge}).drop("_last", "_first", *[f"_sum_{n}" for n in sums])
    table = table.withColumnsRenamed({k: f"_b{k}" for k in cells})
    line = W.partitionBy(*cells).orderBy(*order)
    inner = placed.withColumns({f"_in_{n}": F.sum(f"_of_{n}").over(line.rowsBetween(W.unboundedPreceding, 0)) for n in sums} | {"_lag": F.lag(value).over(line), "_no": F.row_number().over(line)})
    met = inner.join(table, _same(cells, "_b"))
    out = {n: F.col(f"_in_{n}") + F.col(f"_before_{n}") for n in sums} | ({previous: F.when(F.col("_no") == 1, F.col("_edge")).otherwise(F.col("_lag"))} if previous else {})
    return met.withColumns(out).select(*kept)


def _ranged(df: DataFrame, keys: list[str], value: str, tie: str, ranges: int, rows: int) -> DataFrame:
    """``df`` with ``_range``, by value, and ``_part``, by tie where more than ``rows`` rows share a value at which a cut falls."""
    levels = [i / ranges for i in range(1, ranges)]
    none = F.expr("cast(array() as array<double>)")
    sketch = F.percentile_approx(F.col(value).cast("double"), levels, max(1000, 20 * ranges))
    bounds = df.groupBy(*keys).agg(F.array_distinct(sketch).alias("_bounds"))
    v = F.col(value).cast("double")
    below, upto = (F.size(F.filter(F.coalesce("_bounds", none), test)) for test in (lambda b: b < v, lambda b: b <= v))
    placed = df.join(bounds.withColumnsRenamed({k: f"_b{k}" for k in keys}), _same(keys, "_b"))
    placed = placed.withColumn("_range", F.when(F.col(value).isNull(), -1).otherwise(below + upto)).drop("_bounds", *[f"_b{k}" for k in keys])
    shared = placed.where((F.col("_range") % 2 == 1) | (F.col("_range") == -1))  # of one value each
    ties = [i / MAX_RANGES for i in range(1, MAX_RANGES, max(1, MAX_RANGES // ranges))]
    cuts = shared.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"), F.array_distinct(F.percentile_approx(F.col(tie).cast("double"), ties, max(1000, 20 * ranges))).alias("_ties"))
    cuts = cuts.where(F.col("_n") > rows).withColumnsRenamed({k: f"_b{k}" for k in [*keys, "_range"]}).drop("_n")
    met = placed.join(cuts, _same([*keys, "_range"], "_b"), "left")
    part = F.size(F.filter(F.coalesce("_ties", none), lambda b: b < F.col(tie).cast("double")))
    return met.withColumn("_part", part).drop("_ties", *[f"_b{k}" for k in [*keys, "_range"]])


def _same(keys: list[str], prefix: str) -> Column:
    """Equal keys, nulls included."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return out


def shuffled(subjects: DataFrame, seed: int = 0) -> DataFrame:
    """``subjects`` with ``rn``, the place from 0 in the shuffled order of their label, and ``n``, the label's rows."""
    hashed = subjects.withColumn("_hash", order_hash(seed=seed))
    ranked = running(hashed, ["label"], "_hash", "subject", {"rn": F.lit(1).cast("long")})
    return ranked.withColumn("rn", F.col("rn") - 1).withColumnRenamed("all_rn", "n").drop("_hash")


def train_test_split(subjects: DataFrame, percentage: float = 0.3, seed: int = 0) -> DataFrame:
    """(subject, label, part): the first share of each class in shuffled order is the test; others than +-1 are train."""
    known = subjects.where(F.abs("label") == 1)
    test = shuffled(known, seed).where(F.col("rn") + 1 <= F.floor(percentage * F.col("n"))).select("subject")
    tested = subjects.join(test, "subject", "left_semi").withColumn("part", F.lit("test"))
    return tested.unionByName(subjects.join(test, "subject", "left_anti").withColumn("part", F.lit("train")))


def stratified_folds(subjects: DataFrame, k: int = 8, seed: int = 0) -> DataFrame:
    """(subject, label, fold): cuts at floor(j n / k) of each class in shuffled order."""
    cuts = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.floor(j * F.col("n") / k) <= F.col("rn"))
    return shuffled(subjects, seed).select("subject", "label", F.array_max(cuts).alias("fold"))


def loso_folds(subjects: DataFrame) -> DataFrame:
    """One fold for each subject."""
    return subjects.select("subject", "label", F.col("subject").alias("fold"))


def running_counts(scores: DataFrame, by: list[str] = ()) -> DataFrame:
    """Adds tp, fp, n_pos, n_neg: counts down to each row by descending score, then descending subject."""
    pos = (F.col("label") == 1).cast("long")
    counted = running(scores, list(by), "score", "subject", {"tp": F.coalesce(pos, F.lit(0)), "fp": F.coalesce(1 - pos, F.lit(1))}, descending=True)
    return counted.withColumnsRenamed({"all_tp": "n_pos", "all_fp": "n_neg"})


def roc_curve(scores: DataFrame) -> DataFrame:
    c = running_counts(scores)
    return c.select("subject", "score", (F.col("fp") / F.col("n_neg")).alias("fpr"), (F.col("tp") / F.col("n_pos")).alias("tpr"))


def precision_recall_curve(scores: DataFrame) -> DataFrame:
    c = running_counts(scores)
    return c.select("subject", "score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("n_pos")).alias("recall"))


def best_recall(curve: DataFrame, precision: float) -> DataFrame:
    return curve.agg(F.max(F.when(F.col("precision") >= precision, F.col("recall"))).alias("best_recall"))


def best_precision(curve: DataFrame, recall: float) -> DataFrame:
    return curve.agg(F.max(F.when(F.col("recall") >= recall, F.col("precision"))).alias("best_precision"))


def auc(scores: DataFrame, by: list[str] = ()) -> DataFrame:
    """Area under the curve that ranks rows one by one; ties in the order of running_counts. With ``by``, one for each group.

    Each negative adds the positives above it. Groups of one class only have none.
    """
    c = running_counts(scores, list(by))
    pairs = F.first(F.col("n_pos") * F.col("n_neg"))
    return c.groupBy(*by).agg((F.coalesce(F.sum(F.when(F.col("label") != 1, F.col("tp"))), F.lit(0)) / F.when(pairs > 0, pairs)).alias("auc"))


def pair_score(scores: DataFrame) -> DataFrame:
    """(accuracy, ties) over all pairs of a positive and a negative: share of pairs won among those without a tie, share of ties.

    Every positive wins against the negatives below it and ties with those of its own score. No pair is made: the
    negatives above come from running_counts, those of the same score from counts by score.
    """
    counts = running_counts(scores)
    same = scores.groupBy("score").agg(F.sum((F.col("label") != 1).cast("long")).alias("equal"), F.sum((F.col("label") == 1).cast("long")).alias("pos"))
    top = counts.groupBy("score").agg(F.max("fp").alias("upto"), F.first("n_pos").alias("n_pos"), F.first("n_neg").alias("n_neg"))
    each = same.join(top, "score").agg(
        F.sum(F.col("pos") * (F.col("n_neg") - F.col("upto"))).alias("won"), F.sum(F.col("pos") * F.col("equal")).alias("tied"), F.first(F.col("n_pos") * F.col("n_neg")).alias("every")
    )
    return each.select((F.col("won") / (F.col("every") - F.col("tied"))).alias("accuracy"), (F.col("tied") / F.col("every")).alias("ties"))


def opposite_pairs(subjects: DataFrame, tries: int, seed: int = 0) -> DataFrame:
    """(pos, neg): ``tries`` pairs drawn from all pairs of a positive and a negative, repeated draws once.

    Draw k takes two places in the shuffled orders of the classes; places meet rows by equi-joins, so no product is made.
    """
    ranked = shuffled(subjects.where(F.abs("label") == 1), seed)
    sizes = ranked.agg(F.max(F.when(F.col("label") == 1, F.col("n"))).alias("p"), F.max(F.when(F.col("label") == -1, F.col("n"))).alias("q"))  # one row
    k = F.col("id")
    drawn = subjects.sparkSession.range(tries).crossJoin(F.broadcast(sizes)).where("p > 0 and q > 0")
    drawn = drawn.select(((k * 7919 + seed) % F.col("p")).alias("a"), ((k * 104729 + seed) % F.col("q")).alias("b")).distinct()
    of = lambda label, name, at: ranked.where(F.col("label") == label).select(F.col("subject").alias(name), F.col("rn").alias(at))
    return drawn.join(of(1, "pos", "a"), "a").join(of(-1, "neg", "b"), "b").select("pos", "neg")


def pair_results(pairs: DataFrame, by: list[str] = ()) -> DataFrame:
    """(accuracy, ties) of pairs with their scores ``s_pos`` and ``s_neg``."""
    won, tied = F.sum((F.col("s_pos") > F.col("s_neg")).cast("long")), F.sum((F.col("s_pos") == F.col("s_neg")).cast("long"))
    n = F.count(F.lit(1))
    return pairs.groupBy(*by).agg((won / F.when(n > tied, n - tied)).alias("accuracy"), (tied / n).alias("ties"))


def best_parameter(results: DataFrame) -> DataFrame:
    """(model, params, mean): the parameters of each model with the best mean fold score, to nine decimals, ties to the first name."""
    means = results.groupBy("model", "params").agg(F.avg("score").alias("mean"))
    order = W.partitionBy("model").orderBy(F.desc(F.round("mean", 9)), "params")
    return means.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")
