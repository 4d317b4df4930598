"""Motion statistics of single series, from long, gap-free frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from motionmill.functions.kernels import CHAN, convolve, kernel_table

SERIES = ["subject", "stimulus"]


def centred(long: DataFrame) -> DataFrame:
    return long.withColumn("value", F.col("value") - F.avg("value").over(W.partitionBy(*CHAN)))


def smoothed(long: DataFrame, scale: float, fps: float) -> DataFrame:
    return convolve(long, kernel_table(long.sparkSession, [("gaussian", scale)], fps)).drop("filter", "scale")


def channel_correlation(long: DataFrame) -> DataFrame:
    """(subject, stimulus, c1, c2, value): population correlation of all channel pairs; undefined ones are 0, own ones 1.

    Pairs with c1 < c2 are joined on the frame and mirrored. The covariance is divided only where both channels vary, since
    ``corr`` raises on a series of one value.
    """
    a = long.select(*SERIES, "frame", F.col("channel").alias("c1"), F.col("value").alias("a"))
    b = long.select(*SERIES, "frame", F.col("channel").alias("c2"), F.col("value").alias("b"))
    spread = F.stddev_pop("a") * F.stddev_pop("b")
    r = F.coalesce(F.nanvl(F.covar_pop("a", "b") / F.when(spread > 0, spread), F.lit(0.0)), F.lit(0.0))
    both = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), True)  # frames that both channels know
    met = a.join(b, [*SERIES, "frame"]).where("c1 < c2").withColumns({"a": F.when(both, F.col("a")), "b": F.when(both, F.col("b"))})
    upper = met.groupBy(*SERIES, "c1", "c2").agg(r.alias("value"))
    lower = upper.select(*SERIES, F.col("c2").alias("c1"), F.col("c1").alias("c2"), "value")
    own = long.select(*SERIES, F.col("channel").alias("c1"), F.col("channel").alias("c2")).distinct().withColumn("value", F.lit(1.0))
    return upper.unionByName(lower).unionByName(own)


def lag_autocorrelation(long: DataFrame, lag: int = 30) -> DataFrame:
    """Covariance of a frame with that ``lag`` later, each slice with its own mean, over the full variance."""
    later = F.lead("value", lag).over(W.partitionBy(*CHAN).orderBy("frame"))
    return long.withColumn("later", later).groupBy(*CHAN).agg((F.covar_pop("later", "value") / F.when(F.var_pop("value") > 0, F.var_pop("value"))).alias("value"))


def micromovement(long: DataFrame, fps: float, scale: float = 10) -> DataFrame:
    """Mean distance of the centred signal from its smoothed self."""
    flat = centred(long)
    soft = smoothed(flat, scale, fps).withColumnRenamed("value", "soft")
    return flat.join(soft, [*CHAN, "frame"]).groupBy(*CHAN).agg(F.avg(F.abs(F.col("value") - F.col("soft"))).alias("value"))


def asymmetric_movement(long: DataFrame) -> DataFrame:
    return long.groupBy(*CHAN).agg(F.avg(F.abs("value")).alias("value"))


def motion_amount(long: DataFrame, fps: float, scale: float = 5) -> DataFrame:
    """cumulative (mean size) and variability (variance) of the smoothed, centred signal."""
    return smoothed(centred(long), scale, fps).groupBy(*CHAN).agg(F.avg(F.abs("value")).alias("cumulative"), F.var_pop("value").alias("variability"))


def blink_rate(long: DataFrame, fps: float, scale: float = 5, closed: float = 0.3) -> DataFrame:
    """Rising edges of the smoothed mask of frames under ``closed``."""
    mask = smoothed(long.withColumn("value", (F.col("value") < closed).cast("double")), scale, fps)
    on = mask.withColumn("on", (F.col("value") > 0.01).cast("int"))
    edge = F.col("on") - F.lag("on").over(W.partitionBy(*CHAN).orderBy("frame"))
    return on.withColumn("edge", edge).groupBy(*CHAN).agg(F.count(F.when(F.col("edge") > 0.5, 1)).alias("blinks"))


def local_maxima(long: DataFrame, thres: float) -> DataFrame:
    """Frames whose size is at least the one before and above the one after, and ``thres`` times the channel's largest."""
    order = W.partitionBy(*CHAN).orderBy("frame")
    size = F.abs("value")
    marked = long.withColumns({"size": size, "before": F.lag(size).over(order), "after": F.lead(size).over(order), "top": F.max(size).over(W.partitionBy(*CHAN))})
    peak = (F.col("before").isNull() | (F.col("size") >= F.col("before"))) & (F.col("after").isNull() | (F.col("size") > F.col("after")))
    return marked.where(peak & (F.col("size") >= thres * F.col("top"))).select(*CHAN, "frame", "value")


def motor_behaviors(long: DataFrame, fps: float, lag: int = 30, small: float = 10, large: float = 5, closed: float = 0.3) -> DataFrame:
    """All motion features in long form: (subject, stimulus, feature, value).

    Values, centred values and the mask of closed frames are smoothed in one pass, both scales together, and all features
    of a channel come from one aggregate of it.
    """
    flat = long.withColumns({"mean": F.avg("value").over(W.partitionBy(*CHAN))})
    kernel = kernel_table(long.sparkSession, [("gaussian", small), ("gaussian", large)], fps)
    v, w = F.col("value") - F.col("mean"), F.col("weight")
    at = lambda s, x: F.sum(F.when(F.col("scale") == float(s), x * w))
    own = (F.col("offset") == 0) & (F.col("scale") == float(large))
    spread = flat.join(F.broadcast(kernel)).select("*", (F.col("frame") + F.col("offset")).alias("at"))
    met = spread.groupBy(*CHAN, F.col("at").alias("frame")).agg(
        F.max(F.when(own, F.col("value"))).alias("value"), F.max(F.when(own, v)).alias("flat"), at(small, v).alias("soft"), at(large, v).alias("softer"),
        at(large, (F.col("value") < closed).cast("double")).alias("mask"),
    ).where("flat is not null")
    order = W.partitionBy(*CHAN).orderBy("frame")
    on = (F.col("mask") > 0.01).cast("int")
    told = met.withColumns({"later": F.lead("value", lag).over(order), "edge": on - F.lag(on).over(order)})
    stats = told.groupBy(*CHAN).agg(
        F.avg(F.abs("value")).alias("asymmetry"), F.avg(F.abs(F.col("flat") - F.col("soft"))).alias("micro"),
        (F.covar_pop("later", "value") / F.when(F.var_pop("value") > 0, F.var_pop("value"))).alias("lag"),
        F.avg(F.abs("softer")).alias("cumulative"), F.var_pop("softer").alias("variability"), F.count(F.when(F.col("edge") > 0.5, 1)).cast("double").alias("blinks"),
    )
    names = ["asymmetry", "micro", "lag", "cumulative", "variability", "blinks"]
    each = F.explode(F.array(*[F.struct(F.concat_ws(":", F.lit(n), "channel").alias("feature"), F.col(n).alias("value")) for n in names]))
    pairs = channel_correlation(long).select(*SERIES, F.concat_ws(":", F.lit("corr"), "c1", "c2").alias("feature"), "value")
    return stats.select(*SERIES, each.alias("f")).select(*SERIES, "f.*").unionByName(pairs)
