"""Queries on the small building blocks and the hooks for user functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from motionmill.functions import geometry, kernels
from motionmill.jobs.catalog import FLAT, GAUSS, SCALE, SOFT, _dist, _proj, filled, long, query, r, rounded, stored
from motionmill.jobs.catalog_models import BANK, BANK_SQL, BANKED, PADDED, PLACED_CTES, SECOND, lengths, placed, second_ctes
from motionmill.operators import design as dz, dictionary as dc, layers as ly, motion
from motionmill.sources import adapters as ad

CHAN = "subject, stimulus, channel"


@query(
    "median_normalize",
    f"""SELECT {CHAN}, frame, round(CASE WHEN ratio > 0 THEN greatest(log2(ratio), -2) WHEN ratio = 0 THEN -2 ELSE 0 END, 6) + 0.0 AS log_ratio, round(coalesce(ratio, 0), 6) + 0.0 AS ratio
    FROM (SELECT *, value / nullif(median(value) OVER (PARTITION BY {CHAN}), 0) AS ratio FROM long)""",
)
def median_normalize(spark, d):
    n = lambda log: geometry.median_normalize(F.col("value"), kernels.CHAN, log)
    return rounded(long(spark, d).select(*kernels.CHAN, "frame", n(True).alias("log_ratio"), n(False).alias("ratio")), "log_ratio", "ratio")


@query("motion_variability", f"SELECT {CHAN}, {r('var_pop(value) AS variability')} FROM soft GROUP BY {CHAN}", GAUSS, FLAT, SOFT)
def motion_variability(spark, d):
    return rounded(motion.motion_amount(long(spark, d), ad.FPS, SCALE).drop("cumulative"), "variability")


@query("pool", SECOND.replace("FROM second", "FROM second WHERE filter = 'gaussian' AND scale = 8"), ("bank", BANK_SQL), BANKED, *second_ctes([8.0], "min"))
def pool(spark, d):
    """The pooling function is the caller's."""
    return rounded(ly.second_layer(filled(spark, d), ad.CHANNELS, BANK[:1], [8.0], ad.FPS, pool=np.min), "value")


@query("point_distance", f"SELECT sample_idx, round({_dist(4, 22)} + {_dist(5, 25)}, 6) + 0.0 AS distance FROM marks")
def point_distance(spark, d):
    l = F.col("landmarks")
    both = geometry.point_distance(l, 4, 22) + geometry.point_distance(l, 5, 25)
    return rounded(ad.landmarks(spark, d).select("sample_idx", both.alias("distance")), "distance")


@query("projected_distance", f"SELECT sample_idx, round({_proj(4, 5, 19, 28)}, 6) + 0.0 AS projected FROM marks")
def projected_distance(spark, d):
    return rounded(ad.landmarks(spark, d).select("sample_idx", geometry.projected_distance(F.col("landmarks"), 4, 5, 19, 28).alias("projected")), "projected")


@query("series_extractor", f"SELECT {CHAN}, {r('avg(value) AS mean', 'max(value) AS top')} FROM long GROUP BY {CHAN}")
def series_extractor(spark, d):
    def extract(m: np.ndarray):
        for c, row in zip(ad.CHANNELS, m):
            yield c, float(row.mean()), float(row.max())

    return rounded(ly.series_extractor(filled(spark, d), extract, "channel string, mean double, top double"), "mean", "top")


@query("odd_reflect", f"SELECT {CHAN}, place, {r('value')} FROM padded", PADDED)
def odd_reflect(spark, d):
    """Series padded to the next power of two, 64 places."""

    def extract(cube: np.ndarray):
        yield np.arange(64), dc.odd_reflect(cube, 64)[0]

    return rounded(ly.cube_extractor(filled(spark, d), ad.CHANNELS, extract, "place int, value double"), "value")


@query(
    "resample_pattern",
    """SELECT subject, stimulus, channel, place, round(value + coalesce(further - value, 0) * (spot - frame), 6) + 0.0 AS value
    FROM (SELECT *, lead(value) OVER (PARTITION BY subject, stimulus, channel ORDER BY frame) AS further FROM long)
    JOIN (SELECT stimulus, CAST(place AS INT) AS place, place * (n_frames - 1) / 15.0::DOUBLE AS spot, CAST(floor(place * (n_frames - 1) / 15.0::DOUBLE) AS INT) AS frame FROM stimuli, range(16) g(place)) USING (stimulus, frame)""",
)
def resample_pattern(spark, d):
    def extract(m: np.ndarray):
        for c, row in zip(ad.CHANNELS, m):
            yield c, np.arange(16), dc.rescale(row, 16)

    return rounded(ly.series_extractor(filled(spark, d), extract, "channel string, place int, value double"), "value")


@query("atom_at", f"SELECT subject, stimulus, channel || '|gaussian|' || CAST(scale_idx AS VARCHAR) || '|' || CAST(pos AS VARCHAR) AS channel, {r('sum(w * w) AS energy')} FROM spread GROUP BY ALL", *PLACED_CTES)
def atom_at(spark, d):
    """Energy of each atom inside its series, summed over the atoms' frames."""
    alone = placed(spark, d).withColumn("channel", F.concat_ws("|", "channel", "atom", "scale_idx", "pos")).withColumn("amp", F.lit(1.0))
    return rounded(dc.rebuild_signal(alone, lengths(spark), ad.FPS).groupBy(*kernels.CHAN).agg(F.sum(F.col("value") * F.col("value")).alias("energy")), "energy")


@query(
    "feature_names",
    """SELECT row_number() OVER (ORDER BY stimulus, channel, block) - 1 AS feature_id, concat_ws(' ', stimulus, channel, block) AS name
    FROM (SELECT DISTINCT stimulus FROM long), (SELECT DISTINCT channel FROM long), (SELECT DISTINCT frame // 10 AS block FROM long)""",
)
def feature_names(spark, d):
    """Names of all combinations of the stimuli, channels and blocks of ten frames that are met."""
    met = stored(spark, lambda: long(spark, d).select("stimulus", "channel", F.floor(F.col("frame") / 10).alias("block")).distinct())
    values = {c: sorted(r[0] for r in met.select(c).distinct().collect()) for c in met.columns}  # the calendar's
    return dz.feature_names(spark, **values)


@query(
    "density_transforms",
    "SELECT subject, feature_id, round(1 / x, 6) + 0.0 AS inverse, CAST(x < 0.1 AS INT) AS rare, round(CASE WHEN x < 0.05 THEN 1 / x ELSE 0 END, 6) + 0.0 AS rare_inverse, CAST(sign(value) AS INT) AS side FROM (SELECT *, abs(value) + 0.01::DOUBLE AS x FROM design)",
)
def density_transforms(spark, d):
    x = F.abs("value") + 0.01
    out = ad.design(spark, d).select(
        "subject", F.col("feature_id").cast("long").alias("feature_id"), (1 / x).alias("inverse"), (x < 0.1).cast("int").alias("rare"),
        F.when(x < 0.05, 1 / x).otherwise(0.0).alias("rare_inverse"), F.signum("value").cast("int").alias("side"),
    )
    return rounded(out, "inverse", "rare_inverse")


