"""The long design table: (subject, feature_id, value, label). Never one column per feature."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from motionmill.operators.evaluate import running


def concat_designs(parts: list[DataFrame]) -> DataFrame:
    """Designs side by side, the ids of each shifted past those before."""
    out, offset = None, 0
    for p in parts:
        n = p.agg(F.coalesce(F.max("feature_id") + 1, F.lit(0))).first()[0]
        moved = p.withColumn("feature_id", F.col("feature_id") + offset)
        out, offset = moved if out is None else out.unionByName(moved), offset + n
    return out


def cast_design(long: DataFrame, lengths: dict[int, int], channels: list[str]) -> DataFrame:
    """Frames of all stimuli as features of the subject: stimulus after stimulus, channel after channel."""
    base, offsets = 0, []
    for stimulus in sorted(lengths):
        for c in channels:
            offsets.append((stimulus, c, base))
            base += lengths[stimulus]
    table = long.sparkSession.createDataFrame(offsets, "stimulus int, channel string, base int")
    return long.join(F.broadcast(table), ["stimulus", "channel"]).select(
        "subject", (F.col("base") + F.col("frame")).cast("long").alias("feature_id"), "value"
    )


def feature_names(spark, **dimensions: list) -> DataFrame:
    """(feature_id, name): all combinations of the dimensions, the last running fastest."""
    out = spark.range(1).select(F.lit(0).cast("long").alias("feature_id"), F.lit("").alias("name"))
    for values in dimensions.values():
        step = F.posexplode(F.array(*[F.lit(str(v)) for v in values])).alias("i", "part")
        out = out.select("feature_id", "name", step).select(
            (F.col("feature_id") * len(values) + F.col("i")).alias("feature_id"), F.concat_ws(" ", F.when(F.col("name") != "", F.col("name")), "part").alias("name")
        )
    return out


#: Rows of a table of features up to which it is broadcast.
FEATURE_ROWS = 200_000


def number_features(rows: DataFrame, parts: list[str]) -> DataFrame:
    """(feature_id, parts): every combination of ``parts`` that is met, numbered from 0 in their order.

    The table of dimensions of a layer: it has a row for each feature, however many subjects there are.
    """
    return rows.select(*parts).distinct().withColumn("feature_id", F.row_number().over(W.orderBy(*parts)).cast("long") - 1).select("feature_id", *parts)


def design_form(rows: DataFrame, features: DataFrame, parts: list[str]) -> DataFrame:
    """(subject, feature_id, value) of a layer's rows; ids come from the table of features, values are finite."""
    table = F.broadcast(features) if features.limit(FEATURE_ROWS + 1).count() <= FEATURE_ROWS else features
    clean = F.when(F.isnan("value") | F.isnull("value") | (F.abs("value") == float("inf")), 0.0).otherwise(F.col("value").cast("double"))
    return rows.join(table, parts).select("subject", "feature_id", clean.alias("value"))


def zscore_features(design: DataFrame) -> DataFrame:
    """Standardised by feature, missing values as 0; constant features go."""
    clean = design.withColumn("value", F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)))
    stats = clean.groupBy("feature_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).where(F.col("std") > 0)
    return clean.join(stats, "feature_id").select("subject", "feature_id", ((F.col("value") - F.col("mean")) / F.col("std")).alias("value"), "label")


def add_offset(design: DataFrame, feature_id: int = -1) -> DataFrame:
    """One more feature that is 1 for every subject."""
    one = design.select("subject", "label").distinct().select("subject", F.lit(feature_id).alias("feature_id"), F.lit(1.0).alias("value"), "label")
    return design.unionByName(one.select(*design.columns))


def weight_labels(subjects: DataFrame) -> DataFrame:
    """Balanced targets and weights: target -2 P(pos) or 2 P(neg), weight 1 / class size. ``subjects``: subject, label."""
    sizes = subjects.agg(F.count("label").alias("n"), F.count(F.when(F.col("label") == 1, 1)).alias("n_pos"))  # one row
    joined = subjects.crossJoin(F.broadcast(sizes))
    pos, neg = F.col("n_pos"), F.col("n") - F.col("n_pos")
    return joined.select(
        "subject", "label",
        F.when(F.col("label") == 1, 2 * neg / F.col("n")).otherwise(-2 * pos / F.col("n")).alias("target"),
        (1 / F.when(F.col("label") == 1, pos).otherwise(neg)).alias("weight"),
    )


def ranked_values(design: DataFrame, by: list[str]) -> DataFrame:
    """``design`` with rn (from 1), n and the value before, in the order of value, then subject, of each group."""
    ranked = running(design, by, "value", "subject", {"rn": F.lit(1).cast("long")}, previous="before")
    return ranked.withColumnRenamed("all_rn", "n")


def purity(ranked: DataFrame, by: list[str]) -> DataFrame:
    """(by, score, share, n): share of positives among the lowest and the highest tenth of values, the larger of both; and of all."""
    k = F.greatest(F.floor(F.col("n") / 10), F.lit(1))
    positive = (F.col("label") == 1).cast("double")
    low, high = F.avg(F.when(F.col("rn") <= k, positive)), F.avg(F.when(F.col("rn") > F.col("n") - k, positive))
    return ranked.groupBy(*by).agg(F.greatest(low, high).alias("score"), F.avg(positive).alias("share"), F.first("n").alias("n"))


def extreme_purity(design: DataFrame) -> DataFrame:
    """(feature_id, score)."""
    return purity(ranked_values(design, ["feature_id"]), ["feature_id"]).select("feature_id", "score")


def rank_features(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.desc("score"), "feature_id")


def top_features(scores: DataFrame, n: int = 1000) -> DataFrame:
    return rank_features(scores).limit(n)


def select_by_deviation(scores: DataFrame, thres: float = 0.21) -> DataFrame:
    """Features whose score is at least ``thres`` from the median of all, by that distance."""
    middle = scores.agg(F.median("score").alias("middle"))  # one row
    off = F.abs(F.col("score") - F.col("middle"))
    return scores.crossJoin(F.broadcast(middle)).select("feature_id", off.alias("deviation")).where(F.col("deviation") >= thres).orderBy(F.desc("deviation"), "feature_id")


def gap_cuts(ranked: DataFrame, by: list[str], thres: float) -> DataFrame:
    """(by, cut): the value above a gap of at least ``thres`` of the group's largest, nearest to the middle rank."""
    gap = F.col("value") - F.col("before")
    widest = ranked.groupBy(*by).agg(F.max(gap).alias("widest"))
    wide = ranked.join(widest, by).where(gap >= thres * F.col("widest"))
    return wide.groupBy(*by).agg(F.min_by("value", F.struct(F.abs(F.col("rn") - 1 - F.col("n") / 2), "rn")).alias("cut"))


def gap_split(design: DataFrame, scores: DataFrame, thres: float) -> DataFrame:
    """(feature_id, cut) of the best feature."""
    best = scores.orderBy(F.desc("score"), "feature_id").limit(1).select("feature_id")  # one row
    return gap_cuts(ranked_values(design.join(F.broadcast(best), "feature_id"), ["feature_id"]), ["feature_id"], thres)


def class_log_ratio(design: DataFrame, phi) -> DataFrame:
    """(feature_id, weight): log mean of phi(value) over positives minus that over negatives."""
    x = phi(F.col("value"))
    mean = lambda v: F.log(F.avg(F.when(F.col("label") == v, x)))
    return design.groupBy("feature_id").agg((mean(1) - mean(-1)).alias("weight"))


def detection_score(design: DataFrame, weights: DataFrame, psi) -> DataFrame:
    """(subject, score): mean over features of psi(value) times the feature's weight."""
    return design.join(weights, "feature_id").groupBy("subject").agg(F.avg(psi(F.col("value")) * F.col("weight")).alias("score"))


def product_sums(vectors: DataFrame, by: list[str], columns: list[str] = ()) -> DataFrame:
    """(by, i, j, value): sums of products of the entries i of (vector, 1) and j of (vector, 1, columns), for each group.

    Partitions hand on one matrix for each of their groups; its cells are summed with partial aggregates. The last
    entries hold the sums and the number of rows.
    """
    names, kinds = list(columns), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields if f.name in by)

    def partial(batches):
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for key, rows in b.groupby(list(by), dropna=False) if by else [((), b)]:
                if len(rows):
                    x = np.c_[np.stack(rows["vector"].tolist()), np.ones(len(rows))]
                    m = x.T @ np.c_[x, rows[names].to_numpy(float)]
                    sums[key] = sums[key] + m if key in sums else m
        for key, m in sums.items():
            yield pd.DataFrame([[*key, m.shape[1], m.ravel().tolist()]], columns=[*by, "width", "m"])

    rows = vectors.select(*by, "vector", *names).mapInPandas(partial, ", ".join(filter(None, [kinds, "width long, m array<double>"])))
    cells = rows.select(*by, "width", F.posexplode("m").alias("at", "v")).groupBy(*by, "width", "at").agg(F.sum("v").alias("value"))
    return cells.select(*by, F.floor(F.col("at") / F.col("width")).cast("int").alias("i"), (F.col("at") % F.col("width")).cast("int").alias("j"), "value")


def within_class_scatter(vectors: DataFrame) -> DataFrame:
    """(i, j, value): sum over pairs within a class of (x - y)(x - y)^T, from sums of products: 2 (n sum xx^T - s s^T)."""
    cells = product_sums(vectors, ["label"])
    last = cells.groupBy("label").agg(F.max("i").alias("last"), F.max_by("value", F.struct("i", "j")).alias("n"))
    cells = cells.join(last, "label")
    sums = cells.where("j = last").select("label", "i", F.col("value").alias("s"))
    met = cells.where("i < last and j < last").join(sums, ["label", "i"]).join(sums.withColumnsRenamed({"i": "j", "s": "t"}), ["label", "j"])
    return met.groupBy("i", "j").agg(F.sum(2 * (F.col("n") * F.col("value") - F.col("s") * F.col("t"))).alias("value"))
