"""Irregular samples to regular, gap-free frames. A frame row holds all channels: (subject, stimulus, frame, values)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SERIES = ["subject", "stimulus"]


def complete_subjects(samples: DataFrame, n_stimuli: int) -> DataFrame:
    """Samples of subjects that have every stimulus."""
    whole = samples.groupBy("subject").agg(F.countDistinct("stimulus").alias("n")).where(F.col("n") == n_stimuli)
    return samples.join(whole, "subject", "left_semi")


def frame_index(t: Column, fps: float) -> Column:
    """The frame whose open interval of one frame length around i / fps holds t; null on a boundary."""
    at = t * fps + 0.5
    return F.when(F.floor(at) != at, F.floor(at)).cast("int")


def resample_frames(samples: DataFrame, channels: list[str], stimuli: DataFrame, fps: float) -> DataFrame:
    """The first sample in time of every frame, on the whole grid; frames without samples have null values.

    The choice is an aggregate, so it is combined before the exchange; the grid joins on the same keys. Only series
    with at least one sample have a grid. ``stimuli`` is a calendar of a few rows.
    """
    placed = samples.withColumn("frame", frame_index(F.col("t"), fps))
    values = F.array(*[F.col(c).cast("double") for c in channels])
    first = (
        placed.where("frame is not null and frame >= 0")
        .groupBy(*SERIES, "frame")
        .agg(F.min_by(values, F.struct("t", "sample_idx")).alias("values"))
    )
    grid = samples.select(*SERIES).distinct().join(F.broadcast(stimuli), "stimulus")
    grid = grid.select(*SERIES, F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1)).alias("frame"))
    return grid.join(first, [*SERIES, "frame"], "left")


def fill_gaps(frames: DataFrame, mode: str = "steps") -> DataFrame:
    """Fills frames in which any channel is missing, in all channels, from the nearest valid frames.

    Gaps at either end take the nearest valid values; an inner gap runs from the last valid values to the next, which
    it reaches one frame early (``mode="linear"``: just in time). A series without a valid frame becomes 0.
    """
    order = W.partitionBy(*SERIES).orderBy("frame")
    known = F.when(F.forall("values", lambda v: v.isNotNull()), F.struct("frame", "values"))
    back = F.last(known, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    ahead = F.first(known, ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))
    width = F.size(F.first("values", ignorenulls=True).over(W.partitionBy(*SERIES).orderBy("frame").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    sided = frames.withColumns({"p": back, "q": ahead, "width": width})
    steps = F.col("q.frame") - F.col("p.frame") - (1 if mode == "steps" else 0)
    part = (F.col("frame") - F.col("p.frame")) / steps
    inner = F.transform("p.values", lambda a, i: a + (F.col("q.values")[i] - a) * part)
    filled = (
        F.when(F.col("p").isNull() & F.col("q").isNull(), F.when(F.col("width") > 0, F.array_repeat(F.lit(0.0), F.col("width"))))
        .when(F.col("p").isNull(), F.col("q.values"))
        .when(F.col("q").isNull() | (F.col("p.frame") == F.col("frame")), F.col("p.values"))
        .otherwise(inner)
    )
    return sided.select(*SERIES, "frame", filled.alias("values"))


def long_frames(frames: DataFrame, channels: list[str]) -> DataFrame:
    """One row per channel: (subject, stimulus, channel, frame, value)."""
    pairs = F.arrays_zip(F.array(*[F.lit(c) for c in channels]).alias("channel"), F.col("values").alias("value"))
    return frames.select(*SERIES, "frame", F.inline(pairs)).select(*SERIES, "channel", "frame", "value")


def stack_frames(parts: list[DataFrame]) -> DataFrame:
    """All frames of several cohorts, missing and infinite values as 0."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("value", clean_nonfinite(F.col("value")))


def clean_nonfinite(value: Column) -> Column:
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, 0.0).otherwise(value)


def subsample(long: DataFrame, rate: int) -> DataFrame:
    return long.where(F.col("frame") % rate == 0)


def control_zscore(long: DataFrame, labels: DataFrame, control: int = -1) -> DataFrame:
    """Values standardised by the mean and population deviation of the control subjects' frames of the channel.

    ``labels`` joins by subject; the statistics are one row per channel.
    """
    clean = long.withColumn("value", clean_nonfinite(F.col("value")))
    stats = (
        clean.join(labels.where(F.col("label") == control), "subject", "left_semi")
        .groupBy("channel")
        .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    )
    z = (F.col("value") - F.col("mean")) / F.when(F.col("std") > 0, F.col("std"))
    return clean.join(F.broadcast(stats), "channel").select(*SERIES, "channel", "frame", F.coalesce(z, F.lit(0.0)).alias("value"))


def event_frames(long: DataFrame, windows: DataFrame) -> DataFrame:
    """Frames inside each event window (half-open); windows may overlap, and are a short list."""
    inside = (F.col("frame") >= F.col("begin")) & (F.col("frame") < F.col("end"))
    w = windows.withColumnRenamed("stimulus", "w_stimulus")
    return long.join(F.broadcast(w), (F.col("stimulus") == F.col("w_stimulus")) & inside).drop("w_stimulus", "begin", "end")


def event_stats(cut: DataFrame) -> DataFrame:
    """(event, channel, mean, std) over all subjects; a missing mean is 0, a missing std 1."""
    return cut.groupBy("event", "channel").agg(
        F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop("value"), F.lit(1.0)).alias("std")
    )


def event_zscore(cut: DataFrame, stats: DataFrame) -> DataFrame:
    """Standardised within the event and channel; a deviation of 0 gives 0."""
    z = F.when(F.col("std") > 0, (F.col("value") - F.col("mean")) / F.col("std")).otherwise(0.0)
    return cut.join(F.broadcast(stats), ["event", "channel"]).select("subject", "stimulus", "event", "channel", "frame", z.alias("value"))
