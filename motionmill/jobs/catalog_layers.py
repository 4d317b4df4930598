"""All layers of a cohort and the standard designs made of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from motionmill.jobs.catalog import BIN, BINS_SQL, MOTOR_CTES, binned, filled, labels, long, motor_table, query, regular, scratch, stored, with_channels
from motionmill.jobs.catalog_models import BANK, BANK_SQL, BANKED, CENTRE_CTES, CENTRES, HIST_CTES, MODEL, assigned, histogram, model, second_ctes
from motionmill.operators import density, design as dz, frames as fr, layers as ly
from motionmill.sources import adapters as ad, tables

SERIES = "subject, stimulus"
#: Whole stimuli as windows.
VIDEOS = [(1, "v1", 0, 50), (2, "v2", 0, 50), (4, "v4", 0, 50), (6, "v6", 0, 38)]


def videos(spark, d) -> DataFrame:
    """Frames of whole stimuli with their nearest centre."""
    from motionmill import schema

    c = stored(spark, lambda: fr.event_frames(long(spark, d), schema.event_windows(spark, VIDEOS)))
    z = fr.event_zscore(c, fr.event_stats(c))
    v = z.groupBy("subject", "event", "frame").agg(F.array(*[F.max(F.when(F.col("channel") == x, F.col("value"))) for x in ad.CHANNELS]).alias("vector"))
    return ly.assign_cluster(v, spark.createDataFrame(CENTRES, "cluster int, centre array<double>"))


def layers(spark, d) -> dict[str, Callable[[], DataFrame]]:
    """Every layer by name, its rows as the extractor gives them."""
    last = lambda: model(spark, d).where("event = 'e6'")
    return {
        "face_parameterization": lambda: ly.layer("face_parameterization", with_channels(regular(spark, d)), ad.CHANNELS),
        "preprocess": lambda: ly.layer("preprocess", regular(spark, d), ad.CHANNELS),
        "event": lambda: ly.layer("event", assigned(spark, d), len(CENTRES)),
        "video_response": lambda: ly.layer("video_response", videos(spark, d), len(CENTRES)),
        "pattern_response": lambda: ly.layer("pattern_response", long(spark, d), last()),
        "patterns_response": lambda: ly.layer("patterns_response", long(spark, d), model(spark, d)),
        "first_layer": lambda: ly.layer("first_layer", filled(spark, d), ad.CHANNELS, BANK, ad.FPS),
        "second_layer": lambda: ly.layer("second_layer", filled(spark, d), ad.CHANNELS, BANK, [8.0, 16.0], ad.FPS),
        "assignation": lambda: ly.layer("assignation", binned(spark, d), 5),
        "histogram": lambda: histogram(spark, d),
        "motor_behaviors": lambda: motor_table(spark, d),
    }


def designs(spark, d, names: list[str]) -> dict[str, DataFrame]:
    """The named layers in design form, (subject, feature_id, value), each stored beside its table of features."""
    root, made = scratch(spark), layers(spark, d)
    out = {}
    for name in names:
        rows = tables.materialize(spark, f"{root}/rows/{name}", made[name])
        features = tables.materialize(spark, f"{root}/features/{name}", lambda name=name, rows=rows: dz.number_features(rows, ly.FEATURES[name]))
        out[name] = tables.materialize(spark, f"{root}/{name}", lambda name=name, rows=rows, features=features: dz.design_form(rows, features, ly.FEATURES[name]))
    return out


def standard_designs(spark, d, made: dict[str, DataFrame], thres: float = 0.21) -> dict[str, Callable[[], DataFrame]]:
    """Second layer and motor behaviours side by side, with labels; what deviates of it; and the densities of both."""
    known = labels(spark, d).where("abs(label) = 1")
    root = scratch(spark)
    every = lambda: tables.materialize(spark, f"{root}/all", lambda: dz.concat_designs([made["second_layer"], made["motor_behaviors"]]).join(known, "subject"))

    def small() -> DataFrame:
        keep = dz.select_by_deviation(dz.extreme_purity(every()), thres).select("feature_id")
        return tables.materialize(spark, f"{root}/small", lambda: every().join(keep, "feature_id", "left_semi"))

    dense = lambda df: density.density_binned(df).withColumnRenamed("density", "value")
    return {"st_design_all": every, "small_st_design": small, "st_design_all_proba": lambda: dense(every()), "small_st_design_proba": lambda: dense(small())}


STANDARD = ["second_layer", "motor_behaviors"]


def _told(name: str, source: str) -> str:
    """Rows, features, sum, and the sum of values weighted by their feature's id, of a table (feature_id, value)."""
    return f"SELECT '{name}' AS layer, count(*) AS n, count(DISTINCT feature_id) AS features, round(coalesce(sum(value), 0), 3) + 0.0 AS total, round(coalesce(sum(value * (feature_id % 101)), 0), 2) + 0.0 AS weighted FROM {source}"


def _design(name: str, source: str) -> str:
    """A layer's rows in design form."""
    parts = ", ".join(f'"{p}"' for p in ly.FEATURES[name])
    return f"(SELECT subject, dense_rank() OVER (ORDER BY {parts}) - 1 AS feature_id, coalesce(value, 0) AS value FROM {source})"


def _share(table: str) -> str:
    near = f"(SELECT t.subject, t.event, c.cluster, coalesce(n, 0) / total AS value FROM (SELECT subject, event, CAST(count(*) AS DOUBLE) AS total FROM {table} GROUP BY subject, event) t CROSS JOIN centres c"
    return near + f" LEFT JOIN (SELECT subject, event, cluster, count(*) AS n FROM {table} GROUP BY subject, event, cluster) k ON k.subject = t.subject AND k.event = t.event AND k.cluster = c.cluster)"


def _response(where: str = "") -> str:
    return f"(SELECT subject, stimulus, event, cluster, frame, avg(CASE WHEN std > 0 THEN (value - mean) / std ELSE 0 END * centre) AS value FROM long JOIN model USING (channel) {where} GROUP BY ALL)"


NEAR = dict(CENTRE_CTES)["assigned"]
VIDEO_CTES = (
    ("cut_v", "SELECT l.*, 'v' || CAST(stimulus AS VARCHAR) AS event FROM long l"),
    ("stats_v", "SELECT event, channel, coalesce(avg(value), 0) AS m, coalesce(stddev_pop(value), 1) AS s FROM cut_v GROUP BY event, channel"),
    ("zv", "SELECT subject, event, channel, frame, CASE WHEN s > 0 THEN (value - m) / s ELSE 0 END AS value FROM cut_v JOIN stats_v USING (event, channel)"),
    ("near_v", NEAR.replace("FROM ez", "FROM zv")),
)
DESIGN_CTES = (
    ("st_second", f"SELECT * FROM {_design('second_layer', 'second')}"), ("st_motor", f"SELECT * FROM {_design('motor_behaviors', 'motor')}"),
    ("st_all", """SELECT subject, feature_id, value, label FROM (SELECT * FROM st_second UNION ALL SELECT subject, feature_id + (SELECT max(feature_id) + 1 FROM st_second), value FROM st_motor) JOIN labels_t USING (subject) WHERE abs(label) = 1"""),
    ("st_pure", """SELECT feature_id, greatest(avg(CASE WHEN rn <= k THEN CAST(label = 1 AS DOUBLE) END), avg(CASE WHEN rn > n - k THEN CAST(label = 1 AS DOUBLE) END)) AS score
      FROM (SELECT *, greatest(n // 10, 1) AS k FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY value, subject) AS rn, count(*) OVER (PARTITION BY feature_id) AS n FROM st_all)) GROUP BY feature_id"""),
    ("st_small", "SELECT * FROM st_all WHERE feature_id IN (SELECT feature_id FROM st_pure WHERE abs(score - (SELECT median(score) FROM st_pure)) >= 0.21)"),
)
LAYER_CTES = (*CENTRE_CTES, *VIDEO_CTES, ("model", MODEL), ("bank", BANK_SQL), BANKED, *second_ctes([8.0, 16.0], "max"), *[c for c in HIST_CTES if c[0] not in ("wide_k", "wide_b")], *MOTOR_CTES)
SOURCES = {
    "face_parameterization": "gaps", "preprocess": "long", "event": _share("assigned"), "video_response": _share("near_v"), "pattern_response": _response("WHERE event = 'e6'"),
    "patterns_response": _response(), "first_layer": "banked", "second_layer": "second", "assignation": "hot", "histogram": "hist", "motor_behaviors": "motor",
}
LAYER_SQL = [_told(n, _design(n, source)) for n, source in SOURCES.items()]


def _summary(tables_: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables_.items():
        weighted = F.sum(F.col("value") * (F.col("feature_id") % 101))
        one = df.agg(
            F.lit(name).alias("layer"), F.count(F.lit(1)).alias("n"), F.count_distinct("feature_id").alias("features"), (F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 3) + 0.0).alias("total"),
            (F.round(F.coalesce(weighted, F.lit(0.0)), 2) + 0.0).alias("weighted"))
        out = one if out is None else out.unionByName(one)
    return out


@query("build_all_layers", " UNION ALL ".join(LAYER_SQL), *LAYER_CTES)
def build_all_layers(spark, d):
    """All layers stored in design form; rows, features and sums of each."""
    return _summary(designs(spark, d, list(ly.REGISTRY)))


@query("layer_design", f"SELECT subject, feature_id, round(value, 6) + 0.0 AS value FROM {_design('histogram', 'hist')}", *LAYER_CTES)
def layer_design(spark, d):
    """A layer's rows in design form: the pooled histograms."""
    out = designs(spark, d, ["histogram"])["histogram"]
    return out.withColumn("value", F.round("value", 6) + 0.0)


@query("standard_designs", _told("st_design_all", "st_all") + " UNION ALL " + _told("small_st_design", "st_small"), *LAYER_CTES, *DESIGN_CTES)
def standard_designs_query(spark, d):
    made = standard_designs(spark, d, designs(spark, d, STANDARD))
    return _summary({n: made[n]() for n in ("st_design_all", "small_st_design")})


@query("small_standard_design", "SELECT subject, feature_id, round(value, 6) + 0.0 AS value, label FROM st_small", *LAYER_CTES, *DESIGN_CTES)
def small_standard_design(spark, d):
    """The rows of the features that deviate, with labels."""
    out = standard_designs(spark, d, designs(spark, d, STANDARD))["small_st_design"]()
    return out.select("subject", "feature_id", (F.round("value", 6) + 0.0).alias("value"), "label")


@query("design_densities")
def design_densities(spark, d):
    made = standard_designs(spark, d, designs(spark, d, STANDARD))
    return _summary({n: made[n]() for n in ("st_design_all_proba", "small_st_design_proba")})
