"""Queries over the given tables and their SQL twins.

Results are rounded to ``DIGITS`` decimals on both sides, since sums depend on the order of rows in their last bits.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from motionmill import schema
from motionmill.functions import geometry, kernels
from motionmill.jobs.tables_sql import sql
from motionmill.operators import density, design as dz, evaluate as ev, frames as fr, motion
from motionmill.sources import adapters as ad, tables

DIGITS = 6
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SCALE = 8.0  # of the adapters' kernels: half-width 4 at one frame per time unit


def query(name: str, oracle: str | None = None, *extra: tuple[str, str]):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = sql(oracle, *extra)
        return f

    return keep


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """``names`` to ``DIGITS`` decimals, never minus zero."""
    return df.withColumns({n: F.round(F.col(n), DIGITS) + 0.0 for n in names})


def r(*names: str) -> str:
    pairs = [n.rsplit(" AS ", 1) if " AS " in n else (n, n) for n in names]
    return ", ".join(f"round({e}, {DIGITS}) + 0.0 AS {n}" for e, n in pairs)


#: Added before rounding where many values are multiples of 1/128 and the like, whose last bits would else decide a tie.
NUDGE = 3e-10


def nudged(df: DataFrame, *names: str) -> DataFrame:
    return rounded(df.withColumns({n: F.col(n) + NUDGE for n in names}), *names)


def scratch(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-layers-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named}/{uuid.uuid4().hex}"


# ---------------------------------------------------------------- inputs


def detected(spark, d) -> DataFrame:
    return ad.samples(spark, d).where("detected = 1")


def regular(spark, d) -> DataFrame:
    return fr.resample_frames(detected(spark, d), ad.CHANNELS, schema.stimuli(spark, ad.STIMULI, ad.FPS), ad.FPS)


def filled(spark, d) -> DataFrame:
    return fr.fill_gaps(regular(spark, d))


def long(spark, d) -> DataFrame:
    return fr.long_frames(filled(spark, d), ad.CHANNELS)


def stored(spark, build) -> DataFrame:
    """What ``build`` gives, as a table, for work that reads it more than once."""
    return tables.materialize(spark, scratch(spark), build)


def labels(spark, d) -> DataFrame:
    return ad.subjects(spark, d).select("subject", tables.encode_label(F.col("raw_label")).alias("label"))


def windows(spark) -> DataFrame:
    return schema.event_windows(spark, ad.EVENTS)


def shown(df: DataFrame, column: str = "label") -> DataFrame:
    """Labels as text, ``none`` for unknown ones."""
    return df.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit("none")))


def cut(spark, d) -> DataFrame:
    return fr.event_frames(long(spark, d), windows(spark))


def ids(spark, d) -> DataFrame:
    return ad.vectors(spark, d).select("subject", "label")


# ---------------------------------------------------------------- sources, projections


@query("read_samples", f"SELECT subject, stimulus, sample_idx, detected, {r('t', 'c1', 'c2')} FROM samples")
def read_samples(spark, d):
    path = scratch(spark)
    ad.samples(spark, d).write.partitionBy("stimulus").parquet(path)
    kinds = "subject bigint, sample_idx bigint, t double, detected int, c1 double, c2 double, stimulus int"
    return rounded(tables.read_samples(spark, path, kinds).select("subject", "stimulus", "sample_idx", "detected", "t", "c1", "c2"), "t", "c1", "c2")


@query("read_subjects", "SELECT subject, raw_label FROM subjects")
def read_subjects(spark, d):
    path = scratch(spark)
    ad.subjects(spark, d).write.parquet(path)
    return tables.read_subjects(spark, path).select("subject", "raw_label")


@query("materialize_layer", f"SELECT subject, stimulus, channel, frame, {r('value')} FROM long")
def materialize_layer(spark, d):
    path = scratch(spark)
    tables.materialize(spark, path, lambda: long(spark, d))
    return rounded(tables.materialize(spark, path, lambda: long(spark, d)), "value")


LABEL = "coalesce(CAST(label AS VARCHAR), 'none') AS label"
SPLIT = """SELECT subject, label, CASE WHEN abs(label) = 1 AND rn <= floor(0.3 * n) THEN 'test' ELSE 'train' END AS part FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY subject * 7919 % 10007, subject) AS rn, count(*) OVER (PARTITION BY label) AS n FROM labels_t)"""


@query("write_split", f"SELECT subject AS id, coalesce(CAST(label AS VARCHAR), 'none') AS output, part FROM ({SPLIT})")
def write_split(spark, d):
    path, parts = scratch(spark), ev.train_test_split(labels(spark, d))
    tables.write_split(parts.where("part = 'train'"), parts.where("part = 'test'"), path)
    read = lambda p: spark.read.schema("id bigint, output int").option("header", True).csv(f"{path}/{p}").withColumn("part", F.lit(p))
    return shown(read("train").unionByName(read("test")), "output")


@query("encode_label", f"SELECT subject, {LABEL} FROM labels_t")
def encode_label(spark, d):
    return shown(labels(spark, d))


@query(
    "binarize_answers",
    """SELECT subject, CAST(sum(CAST((subject * 31 + i * 7) % 5 = 0 AS INT)) AS BIGINT) AS failed, string_agg(CAST(CAST((subject * 31 + i * 7) % 5 = 0 AS INT) AS VARCHAR), '' ORDER BY i) AS answers
    FROM subjects, range(20) g(i) GROUP BY subject""",
)
def binarize_answers(spark, d):
    marked = ad.subjects(spark, d).withColumn("a", tables.binarize_answers(F.col("answers")))
    return marked.select("subject", F.aggregate("a", F.lit(0).cast("long"), lambda x, y: x + y).alias("failed"), F.array_join(F.transform("a", lambda x: x.cast("string")), "").alias("answers"))


@query("filter_detected", "SELECT subject, stimulus, count(*) AS n FROM samples WHERE detected = 1 GROUP BY subject, stimulus")
def filter_detected(spark, d):
    return detected(spark, d).groupBy("subject", "stimulus").agg(F.count(F.lit(1)).alias("n"))


@query("keep_label", "SELECT subject, label FROM labels_t WHERE label IN (1, -1)")
def keep_label(spark, d):
    return labels(spark, d).where(F.col("label").isin(1, -1))


@query("clean_nonfinite", f"SELECT subject, stimulus, channel, frame, round(coalesce(value, 0), {DIGITS}) + 0.0 AS value FROM gaps")
def clean_nonfinite(spark, d):
    return rounded(fr.stack_frames([fr.long_frames(with_channels(regular(spark, d)), ad.CHANNELS)]), "value")


def with_channels(frames: DataFrame) -> DataFrame:
    """Null arrays as arrays of nulls, so that the long form keeps their frames."""
    none = F.array(*[F.lit(None).cast("double")] * len(ad.CHANNELS))
    return frames.withColumn("values", F.coalesce("values", none))


def _half(k: int) -> str:
    return f"list_sum(list_slice(l, {1 + 49 * k}, {49 + 49 * k})) / 49"


def _x(p: int) -> str:
    return f"l[{p + 1}]"


def _y(p: int) -> str:
    return f"l[{p + 50}]"


DEPTH = f"sqrt(abs(({_x(28)} - {_x(16)}) * ({_y(16)} - {_y(19)}) - ({_y(16)} - {_y(28)}) * ({_x(19)} - {_x(16)})))"
NORMAL = f"SELECT sample_idx, subject, l, {DEPTH} AS depth, {_half(0)} AS x, {_half(1)} AS y FROM marks"


@query(
    "normalize_landmarks",
    f"""SELECT sample_idx, {r('depth', 'x', 'y')}, round((l[1] - x) / depth, 6) + 0.0 AS first_x, round((l[98] - y) / depth, 6) + 0.0 AS last_y,
    round(list_sum(list_transform(l, lambda v, i: abs(v - CASE WHEN i <= 49 THEN x ELSE y END))) / depth, 6) + 0.0 AS size FROM normal""",
    ("normal", NORMAL),
)
def normalize_landmarks(spark, d):
    n = geometry.normalize_landmarks(ad.landmarks(spark, d))
    size = F.aggregate("normalized", F.lit(0.0), lambda a, b: a + F.abs(b))
    out = n.select("sample_idx", "depth", "x", "y", F.get("normalized", F.lit(0)).alias("first_x"), F.get("normalized", F.lit(97)).alias("last_y"), size.alias("size"))
    return rounded(out, "depth", "x", "y", "first_x", "last_y", "size")


def _dist(i: int, j: int) -> str:
    return f"sqrt(({_x(i)} - {_x(j)}) ** 2 + ({_y(i)} - {_y(j)}) ** 2)"


def _angle(a: int, b: int, c: int, e: int) -> str:
    ux, uy, vx, vy = f"({_x(b)} - {_x(a)})", f"({_y(b)} - {_y(a)})", f"({_x(e)} - {_x(c)})", f"({_y(e)} - {_y(c)})"
    return f"greatest(least(coalesce(({vx} * {uy} - {vy} * {ux}) / nullif({_dist(a, b)} * {_dist(c, e)}, 0), 0), 1), -1)"


def _proj(a: int, b: int, c: int, e: int) -> str:
    return f"((({_x(c)} - {_x(e)}) * ({_x(a)} - {_x(b)}) + ({_y(c)} - {_y(e)}) * ({_y(a)} - {_y(b)})) / nullif({_dist(c, e)}, 0))"


def _normed(expr: str, log: bool = True) -> str:
    ratio = f"({expr}) / nullif(median({expr}) OVER (PARTITION BY subject), 0)"
    return f"CASE WHEN ({ratio}) > 0 THEN greatest(log2({ratio}), -2) WHEN ({ratio}) = 0 THEN -2 ELSE 0 END" if log else f"coalesce({ratio}, 0)"


def _mean_of(points: range, of) -> str:
    return "((" + " + ".join(of(p) for p in points) + f") / {len(points)}.0::DOUBLE)"


YAW = f"""SELECT sample_idx, sqrt((v1x - k1 * ax) ** 2 + (v1y - k1 * ay) ** 2) AS y1, sqrt((v2x - k2 * ax) ** 2 + (v2y - k2 * ay) ** 2) AS y2 FROM (
  SELECT *, (v1x * ax + v1y * ay) / (ax * ax + ay * ay) AS k1, (v2x * ax + v2y * ay) / (ax * ax + ay * ay) AS k2 FROM (
  SELECT sample_idx, {_mean_of(range(31, 49), _x)} - {_x(10)} AS ax, {_mean_of(range(31, 49), _y)} - {_y(10)} AS ay,
    {_x(19)} - {_x(10)} AS v1x, {_y(19)} - {_y(10)} AS v1y, {_x(28)} - {_x(10)} AS v2x, {_y(28)} - {_y(10)} AS v2y FROM marks))"""
PITCH = f"""SELECT sample_idx, 2 * sqrt(({_x(13)} - {_mean_of(range(14, 19), _x)}) ** 2 + ({_y(13)} - {_mean_of(range(14, 19), _y)}) ** 2) AS x1, {_dist(10, 13)} AS x2 FROM marks"""
FACE = {
    "yaw": "(y1 - y2) / (y1 + y2)", "roll": f"({_y(28)} - {_y(19)}) / nullif({_x(19)} - {_x(28)}, 0)", "pitch": "(x1 - x2) / (x1 + x2)",
    "x": "x", "y": "y", "depth": "depth",
    "eyebrow_raise": _normed(f"{_dist(4, 22)} + {_dist(5, 25)}"), "eyebrow_push": _normed(_proj(4, 5, 19, 28)),
    "eye_opening": _normed(f"{_dist(21, 23)} + {_dist(26, 30)}", False), "mouth_width": _normed(_dist(31, 37)), "mouth_opening": _dist(44, 47),
    "lips_protrusion": _normed(f"{_dist(34, 44)} + {_dist(47, 40)}"), "smile": _angle(35, 37, 31, 33),
}


@query(
    "face_channels",
    "SELECT sample_idx, subject, " + ", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in FACE.items()) + " FROM normal JOIN yaw_t USING (sample_idx) JOIN pitch_t USING (sample_idx)",
    ("normal", NORMAL), ("yaw_t", YAW), ("pitch_t", PITCH),
)
def face_channels(spark, d):
    return rounded(geometry.face_channels(ad.landmarks(spark, d), ["subject"]), *schema.FACE_CHANNELS)


ASYM = {
    "inner_eyebrow": _normed(f"{_dist(4, 22)} - {_dist(5, 25)}"), "outer_eyebrow": _normed(f"{_dist(0, 19)} - {_dist(9, 28)}"),
    "eyes": _normed(f"{_dist(21, 23)} - {_dist(26, 30)}", False), "smile": f"{_angle(31, 33, 19, 28)} - {_angle(37, 35, 28, 19)}",
}


@query("asymmetry_channels", "SELECT sample_idx, subject, " + ", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in ASYM.items()) + " FROM marks")
def asymmetry_channels(spark, d):
    return rounded(geometry.asymmetry_channels(ad.landmarks(spark, d), ["subject"]), *schema.ASYMMETRY_CHANNELS)


@query(
    "mirror_landmarks",
    f"SELECT sample_idx, {', '.join(f'round({e}, 6) + 0.0 AS {n}' for n, e in {'p0': '-l[10]', 'p0y': 'l[59]', 'p13': '-l[14]', 'p48': '-l[47]', 'size': 'list_sum(list_transform(l, lambda v, i: v * CASE WHEN i <= 49 THEN -1 ELSE 1 END))'}.items())} FROM marks",
)
def mirror_landmarks(spark, d):
    m = ad.landmarks(spark, d).withColumn("m", geometry.mirror_landmarks(F.col("landmarks")))
    at = lambda i: F.get("m", F.lit(i))
    out = m.select("sample_idx", at(0).alias("p0"), at(49).alias("p0y"), at(13).alias("p13"), at(48).alias("p48"), F.aggregate("m", F.lit(0.0), lambda a, b: a + b).alias("size"))
    return rounded(out, "p0", "p0y", "p13", "p48", "size")


@query(
    "signed_angle",
    f"SELECT sample_idx, round({_angle(35, 37, 31, 33)}, 6) + 0.0 AS angle, round({_dist(4, 22)}, 6) + 0.0 AS distance, round({_proj(4, 5, 19, 28)}, 6) + 0.0 AS projected FROM marks",
)
def signed_angle(spark, d):
    l = F.col("landmarks")
    out = ad.landmarks(spark, d).select(
        "sample_idx", geometry.signed_angle(l, 35, 37, 31, 33).alias("angle"), geometry.point_distance(l, 4, 22).alias("distance"), geometry.projected_distance(l, 4, 5, 19, 28).alias("projected")
    )
    return rounded(out, "angle", "distance", "projected")


@query(
    "weight_labels",
    f"""SELECT subject, label, round(CASE WHEN label = 1 THEN 2 * (n - n_pos) / CAST(n AS DOUBLE) ELSE -2 * n_pos / CAST(n AS DOUBLE) END, 6) + 0.0 AS target,
    round(1.0::DOUBLE / CASE WHEN label = 1 THEN n_pos ELSE n - n_pos END, 6) + 0.0 AS weight FROM ids, (SELECT count(*) AS n, count(*) FILTER (label = 1) AS n_pos FROM ids)""",
)
def weight_labels(spark, d):
    return rounded(dz.weight_labels(ids(spark, d)), "target", "weight")


@query("add_offset", f"SELECT subject, label, count(*) AS n, {r('sum(value) AS total')} FROM (SELECT * FROM design UNION ALL SELECT subject, -1, 1, label FROM ids) GROUP BY subject, label")
def add_offset(spark, d):
    return rounded(dz.add_offset(ad.design(spark, d)).groupBy("subject", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "total")


# ---------------------------------------------------------------- joins, frames


@query("complete_subjects", "SELECT subject, count(*) AS n FROM samples WHERE detected = 1 AND subject IN (SELECT subject FROM samples WHERE detected = 1 GROUP BY subject HAVING count(DISTINCT stimulus) = 4) GROUP BY subject")
def complete_subjects(spark, d):
    return fr.complete_subjects(detected(spark, d), len(ad.STIMULI)).groupBy("subject").agg(F.count(F.lit(1)).alias("n"))


@query("attach_labels", f"SELECT subject, stimulus, sample_idx, {LABEL} FROM samples JOIN labels_t USING (subject)")
def attach_labels(spark, d):
    return shown(ad.samples(spark, d).join(labels(spark, d), "subject").select("subject", "stimulus", "sample_idx", "label"))


@query("train_test_ids", f"SELECT subject, {LABEL}, part FROM ({SPLIT})")
def train_test_ids(spark, d):
    return shown(ev.train_test_split(labels(spark, d)))


@query("train_ids", f"SELECT subject, {LABEL} FROM ({SPLIT}) WHERE part = 'train'")
def train_ids(spark, d):
    every = labels(spark, d)
    test = ev.train_test_split(every).where("part = 'test'").select("subject", "label")
    return shown(every.exceptAll(test))


@query("resample_frames", f"SELECT subject, stimulus, frame, {r('c1', 'c2')} FROM regular")
def resample_frames(spark, d):
    f = regular(spark, d)
    return rounded(f.select("subject", "stimulus", "frame", F.col("values")[0].alias("c1"), F.col("values")[1].alias("c2")), "c1", "c2")


@query("fill_gaps", f"SELECT subject, stimulus, frame, {r('c1', 'c2')} FROM filled")
def fill_gaps(spark, d):
    return rounded(filled(spark, d).select("subject", "stimulus", "frame", F.col("values")[0].alias("c1"), F.col("values")[1].alias("c2")), "c1", "c2")


@query("stack_frames", f"SELECT channel, count(*) AS n, {r('sum(value) AS total')} FROM long GROUP BY channel")
def stack_frames(spark, d):
    return rounded(fr.stack_frames([long(spark, d)]).groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "total")


@query("frame_index", "SELECT sample_idx, CASE WHEN floor(t + 0.5) <> t + 0.5 THEN CAST(floor(t + 0.5) AS INT) END AS frame FROM samples")
def frame_index(spark, d):
    return ad.samples(spark, d).select("sample_idx", fr.frame_index(F.col("t"), ad.FPS).alias("frame"))


@query("subsample", f"SELECT subject, stimulus, channel, frame, {r('value')} FROM long WHERE frame % 4 = 0")
def subsample(spark, d):
    return rounded(fr.subsample(long(spark, d), 4), "value")


@query("control_zscore", f"SELECT subject, stimulus, channel, frame, {r('value')} FROM z")
def control_zscore(spark, d):
    return rounded(fr.control_zscore(stored(spark, lambda: long(spark, d)), labels(spark, d)), "value")


@query("event_frames", f"SELECT subject, event, channel, count(*) AS n, {r('sum(value) AS total')} FROM cut GROUP BY subject, event, channel")
def event_frames(spark, d):
    return rounded(cut(spark, d).groupBy("subject", "event", "channel").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "total")


@query("event_means", f"SELECT subject, event, channel, {r('avg(value) AS mean')} FROM cutz GROUP BY subject, event, channel")
def event_means(spark, d):
    z = fr.control_zscore(stored(spark, lambda: long(spark, d)), labels(spark, d))
    return rounded(fr.event_frames(z, windows(spark)).groupBy("subject", "event", "channel").agg(F.avg("value").alias("mean")), "mean")


@query("event_stats", f"SELECT event, channel, {r('m AS mean', 's AS std')} FROM estats")
def event_stats(spark, d):
    return rounded(fr.event_stats(cut(spark, d)), "mean", "std")


# ---------------------------------------------------------------- kernels, motion


def _kernel_sql(name: str, scale: float, fps: float = 1.0, p: float = 1.0) -> str:
    w = kernels.weights(name, scale, fps, p)
    h = len(w) // 2
    return "SELECT * FROM (VALUES " + ", ".join(f"({k - h}, CAST({float(x)!r} AS DOUBLE))" for k, x in enumerate(w)) + ") AS k(o, w)"


def _conv_sql(source: str, value: str = "value", kern: str = "kern") -> str:
    return f"""SELECT a.subject, a.stimulus, a.channel, a.frame, sum(b.{value} * w) AS value FROM {source} a JOIN {kern} ON true
      JOIN {source} b ON a.subject = b.subject AND a.stimulus = b.stimulus AND a.channel = b.channel AND b.frame = a.frame - o GROUP BY ALL"""


GAUSS, AVERAGE = ("kern", _kernel_sql("gaussian", SCALE)), ("kern", _kernel_sql("average", SCALE))
FLAT = ("flat", "SELECT subject, stimulus, channel, frame, value - avg(value) OVER (PARTITION BY subject, stimulus, channel) AS value FROM long")
SOFT = ("soft", _conv_sql("flat"))


@query("convolve", f"SELECT subject, stimulus, channel, frame, {r('value')} FROM ({_conv_sql('long')})", GAUSS)
def convolve(spark, d):
    return rounded(kernels.convolve(long(spark, d), kernels.kernel_table(spark, [("gaussian", SCALE)], ad.FPS)), "value").drop("filter", "scale")


@query(
    "convolve_weighted",
    f"SELECT a.subject, a.stimulus, a.channel, a.frame, round(a.value / CASE WHEN b.value < 0.01 THEN 1 ELSE b.value END, 6) + 0.0 AS value FROM ({_conv_sql('known')}) a JOIN ({_conv_sql('mask')}) b USING (subject, stimulus, channel, frame)",
    GAUSS, ("known", "SELECT subject, stimulus, channel, frame, coalesce(value, 0) AS value FROM gaps"), ("mask", "SELECT subject, stimulus, channel, frame, CAST(value IS NOT NULL AS DOUBLE) AS value FROM gaps"),
)
def convolve_weighted(spark, d):
    gaps = fr.long_frames(with_channels(regular(spark, d)), ad.CHANNELS)
    return rounded(kernels.convolve_weighted(gaps, kernels.kernel_table(spark, [("gaussian", SCALE)], ad.FPS)), "value").drop("filter", "scale")


@query(
    "local_stats",
    f"""SELECT subject, stimulus, channel, frame, {r('mean', 'square - mean * mean AS var', 'cumul')} FROM (
    SELECT a.subject, a.stimulus, a.channel, a.frame, sum(b.value * w) AS mean, sum(b.value * b.value * w) AS square, sum(abs(b.value) * w) AS cumul FROM long a JOIN kern ON true
    JOIN long b ON a.subject = b.subject AND a.stimulus = b.stimulus AND a.channel = b.channel AND b.frame = a.frame - o GROUP BY ALL)""",
    AVERAGE,
)
def local_stats(spark, d):
    return rounded(kernels.local_stats(long(spark, d), SCALE, ad.FPS), "mean", "var", "cumul")


@query(
    "pool_windows",
    f"""SELECT subject, stimulus, channel, "window", {r('max(value) AS max', 'avg(value) AS mean', 'var_pop(value) AS var')} FROM long l JOIN bounds b ON l.stimulus = b.s AND frame >= b_begin AND frame < b_end
    GROUP BY subject, stimulus, channel, "window" """,
    ("bounds", """SELECT stimulus AS s, i AS "window", i * 7 // 2 AS b_begin, least(i * 7 // 2 + 7, n_frames) AS b_end FROM (SELECT *, unnest(range(greatest(2 * n_frames // 7 - 1, 1))) AS i FROM stimuli)"""),
)
def pool_windows(spark, d):
    out = kernels.pool_windows(long(spark, d), schema.stimuli(spark, ad.STIMULI, ad.FPS), 7.0, ad.FPS)
    return rounded(out, "max", "mean", "var").withColumn("window", F.col("window").cast("long"))


CORR = """SELECT a.subject, a.stimulus, a.channel AS c1, b.channel AS c2,
    CASE WHEN a.channel = b.channel THEN 1 ELSE coalesce(CASE WHEN stddev_pop(a.value) * stddev_pop(b.value) > 0 THEN corr(a.value, b.value) END, 0) END AS value
    FROM long a JOIN long b ON a.subject = b.subject AND a.stimulus = b.stimulus AND a.frame = b.frame GROUP BY a.subject, a.stimulus, a.channel, b.channel"""


@query(
    "channel_correlation",
    f"SELECT subject, stimulus, c1, c2, {r('value')} FROM ({CORR})",
)
def channel_correlation(spark, d):
    return rounded(motion.channel_correlation(long(spark, d)), "value")


@query(
    "lag_autocorrelation",
    f"""SELECT subject, stimulus, channel, round(covar_pop(later, value) / nullif(v, 0), 6) + 0.0 AS value FROM (
    SELECT *, lead(value, 6) OVER (PARTITION BY subject, stimulus, channel ORDER BY frame) AS later, var_pop(value) OVER (PARTITION BY subject, stimulus, channel) AS v FROM long) GROUP BY subject, stimulus, channel, v""",
)
def lag_autocorrelation(spark, d):
    return rounded(motion.lag_autocorrelation(long(spark, d), 6), "value")


@query("micromovement", f"SELECT subject, stimulus, channel, round(avg(abs(f.value - s.value)), 6) + 0.0 AS value FROM flat f JOIN soft s USING (subject, stimulus, channel, frame) GROUP BY subject, stimulus, channel", GAUSS, FLAT, SOFT)
def micromovement(spark, d):
    return rounded(motion.micromovement(long(spark, d), ad.FPS, SCALE), "value")


@query("asymmetric_movement", f"SELECT subject, stimulus, channel, {r('avg(abs(value)) AS value')} FROM long GROUP BY subject, stimulus, channel")
def asymmetric_movement(spark, d):
    return rounded(motion.asymmetric_movement(long(spark, d)), "value")


@query("cumulative_motion", f"SELECT subject, stimulus, channel, {r('avg(abs(value)) AS cumulative', 'var_pop(value) AS variability')} FROM soft GROUP BY subject, stimulus, channel", GAUSS, FLAT, SOFT)
def cumulative_motion(spark, d):
    return rounded(motion.motion_amount(long(spark, d), ad.FPS, SCALE), "cumulative", "variability")


@query(
    "blink_rate",
    f"""SELECT subject, stimulus, channel, count(*) FILTER (on1 - before > 0.5) AS blinks FROM (SELECT *, lag(on1) OVER (PARTITION BY subject, stimulus, channel ORDER BY frame) AS before FROM (
    SELECT *, CAST(value > 0.01 AS INT) AS on1 FROM ({_conv_sql('mask')}))) GROUP BY subject, stimulus, channel""",
    GAUSS, ("mask", "SELECT subject, stimulus, channel, frame, CAST(value < 5 AS DOUBLE) AS value FROM long"),
)
def blink_rate(spark, d):
    return motion.blink_rate(long(spark, d), ad.FPS, SCALE, 5.0)


@query(
    "local_maxima",
    f"""SELECT subject, stimulus, channel, frame, {r('value')} FROM (SELECT *, abs(value) AS a, lag(abs(value)) OVER o AS b, lead(abs(value)) OVER o AS c, max(abs(value)) OVER (PARTITION BY subject, stimulus, channel) AS top FROM long
    WINDOW o AS (PARTITION BY subject, stimulus, channel ORDER BY frame)) WHERE (b IS NULL OR a >= b) AND (c IS NULL OR a > c) AND a >= 0.5 * top""",
)
def local_maxima(spark, d):
    return rounded(motion.local_maxima(long(spark, d), 0.5), "value")


def _feature_sql(name: str, value: str, source: str) -> str:
    return f"SELECT subject, stimulus, '{name}:' || channel AS feature, CAST({value} AS DOUBLE) AS value FROM {source} GROUP BY subject, stimulus, channel"


MOTOR = " UNION ALL ".join([
    _feature_sql("asymmetry", "avg(abs(value))", "long"),
    _feature_sql("micro", "avg(abs(f.value - s.value))", "flat f JOIN s10 s USING (subject, stimulus, channel, frame)"),
    _feature_sql("lag", "covar_pop(later, value) / nullif(var_pop(value), 0)", "(SELECT *, lead(value, 6) OVER (PARTITION BY subject, stimulus, channel ORDER BY frame) AS later FROM long)"),
    _feature_sql("cumulative", "avg(abs(value))", "s5"), _feature_sql("variability", "var_pop(value)", "s5"),
    _feature_sql("blinks", "count(*) FILTER (on1 - before > 0.5)", "(SELECT *, lag(on1) OVER (PARTITION BY subject, stimulus, channel ORDER BY frame) AS before FROM (SELECT *, CAST(value > 0.01 AS INT) AS on1 FROM m5))"),
    f"SELECT subject, stimulus, 'corr:' || c1 || ':' || c2, value FROM ({CORR})",
])
MOTOR_CTES = (
    FLAT, ("k10", _kernel_sql("gaussian", 10.0)), ("k5", _kernel_sql("gaussian", 5.0)), ("s10", _conv_sql("flat", kern="k10")), ("s5", _conv_sql("flat", kern="k5")),
    ("shut", "SELECT subject, stimulus, channel, frame, CAST(value < 0.3 AS DOUBLE) AS value FROM long"), ("m5", _conv_sql("shut", kern="k5")), ("motor", MOTOR),
)


def motor_table(spark, d) -> DataFrame:
    return motion.motor_behaviors(stored(spark, lambda: long(spark, d)), ad.FPS, 6)


@query("motor_behaviors", f"SELECT subject, stimulus, feature, {r('value')} FROM motor", *MOTOR_CTES)
def motor_behaviors(spark, d):
    return rounded(motor_table(spark, d), "value")


BIN_LEVELS = [0.2, 0.4, 0.6, 0.8]
BINS_SQL = ("bins_t", "SELECT channel, " + ", ".join(f"quantile_disc(value, {p}) AS b{i}" for i, p in enumerate(BIN_LEVELS)) + " FROM long GROUP BY channel")


def bins(spark, d, source: DataFrame | None = None) -> DataFrame:
    return density.quantile_bins(source or stored(spark, lambda: long(spark, d)), "channel", BIN_LEVELS, exact=True)


@query("quantile_bins", f"SELECT channel, {r('b0', 'b1', 'b2', 'b3')} FROM bins_t", BINS_SQL)
def quantile_bins(spark, d):
    return rounded(bins(spark, d).select("channel", *[F.col("bins")[i].alias(f"b{i}") for i in range(4)]), "b0", "b1", "b2", "b3")


BIN = "CAST(b0 < value AS INT) + CAST(b1 < value AS INT) + CAST(b2 < value AS INT) + CAST(b3 < value AS INT)"


def binned(spark, d) -> DataFrame:
    source = stored(spark, lambda: long(spark, d))
    return source.join(F.broadcast(bins(spark, d, source)), "channel").select("subject", "stimulus", "channel", "frame", kernels.bin_assign(F.col("value"), F.col("bins")).alias("bin"))


@query("bin_assign", f"SELECT subject, stimulus, channel, frame, {BIN} AS bin FROM long JOIN bins_t USING (channel)", BINS_SQL)
def bin_assign(spark, d):
    return binned(spark, d)


@query("one_hot_bin", f"SELECT subject, stimulus, channel, k, sum(CAST(({BIN}) = k AS BIGINT))::BIGINT AS hits FROM long JOIN bins_t USING (channel), range(5) g(k) GROUP BY subject, stimulus, channel, k", BINS_SQL)
def one_hot_bin(spark, d):
    hot = binned(spark, d).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("k"))
    return hot.groupBy("subject", "stimulus", "channel", "k").agg(F.sum((F.col("bin") == F.col("k")).cast("long")).alias("hits"))


# ---------------------------------------------------------------- design, selection


@query("cast_design", f"SELECT subject, CASE stimulus WHEN 1 THEN 0 WHEN 2 THEN 100 WHEN 4 THEN 200 ELSE 300 END + CASE WHEN channel = 'c2' THEN CASE stimulus WHEN 6 THEN 38 ELSE 50 END ELSE 0 END + frame AS feature_id, {r('value')} FROM long")
def cast_design(spark, d):
    lengths = {k: schema.n_frames(s, ad.FPS) for k, s in ad.STIMULI.items()}
    return rounded(dz.cast_design(long(spark, d), lengths, ad.CHANNELS), "value")


@query("concat_designs", f"SELECT feature_id, count(*) AS n, {r('sum(value) AS total')} FROM (SELECT feature_id, value FROM design UNION ALL SELECT feature_id + 64, value FROM design) GROUP BY feature_id")
def concat_designs(spark, d):
    a = ad.design(spark, d)
    return rounded(dz.concat_designs([a, a]).groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "total").withColumn("feature_id", F.col("feature_id").cast("long"))


@query("zscore_features", f"SELECT subject, feature_id, label, round((value - m) / s, 6) + 0.0 AS value FROM (SELECT *, avg(value) OVER f AS m, stddev_pop(value) OVER f AS s FROM design WINDOW f AS (PARTITION BY feature_id)) WHERE s > 0")
def zscore_features(spark, d):
    return rounded(dz.zscore_features(ad.design(spark, d)), "value").withColumn("feature_id", F.col("feature_id").cast("long"))


def purity(spark, d) -> DataFrame:
    return dz.extreme_purity(ad.design(spark, d))


def _ids(df: DataFrame) -> DataFrame:
    return df.withColumn("feature_id", F.col("feature_id").cast("long"))


@query("extreme_purity", f"SELECT feature_id, {r('score')} FROM purity")
def extreme_purity(spark, d):
    return _ids(rounded(purity(spark, d), "score"))


@query("rank_features", f"SELECT feature_id, {r('score')} FROM purity ORDER BY score DESC, feature_id")
def rank_features(spark, d):
    return _ids(rounded(dz.rank_features(purity(spark, d)), "score"))


@query("top_features", f"SELECT feature_id, {r('score')} FROM (SELECT * FROM purity ORDER BY score DESC, feature_id LIMIT 10)")
def top_features(spark, d):
    return _ids(rounded(dz.top_features(purity(spark, d), 10), "score"))


@query("select_by_deviation", "SELECT feature_id, round(deviation, 6) + 0.0 AS deviation FROM (SELECT feature_id, abs(score - (SELECT median(score) FROM purity)) AS deviation FROM purity) WHERE deviation >= 0.035")
def select_by_deviation(spark, d):
    return _ids(rounded(dz.select_by_deviation(purity(spark, d), 0.035), "deviation"))


@query(
    "gap_split",
    """SELECT feature_id, round(value, 6) + 0.0 AS cut FROM (SELECT *, max(gap) OVER () AS widest FROM (SELECT feature_id, subject, value, value - lag(value) OVER o AS gap, row_number() OVER o - 1 AS rn, count(*) OVER () AS n FROM design
    WHERE feature_id = (SELECT feature_id FROM purity ORDER BY score DESC, feature_id LIMIT 1) WINDOW o AS (ORDER BY value, subject))) WHERE gap >= 0.2 * widest ORDER BY abs(rn - n / 2.0), rn LIMIT 1""",
)
def gap_split(spark, d):
    return _ids(rounded(dz.gap_split(ad.design(spark, d), purity(spark, d), 0.2), "cut"))


PHI = lambda v: 1 / (0.1 + F.abs(v))
RATIO = ("ratio", "SELECT feature_id, ln(avg(CASE WHEN label = 1 THEN 1 / (0.1::DOUBLE + abs(value)) END)) - ln(avg(CASE WHEN label = -1 THEN 1 / (0.1::DOUBLE + abs(value)) END)) AS weight FROM design GROUP BY feature_id")


@query("class_log_ratio", f"SELECT feature_id, {r('weight')} FROM ratio", RATIO)
def class_log_ratio(spark, d):
    return _ids(rounded(dz.class_log_ratio(ad.design(spark, d), PHI), "weight"))


@query("detection_model", "SELECT subject, round(avg(CAST(abs(value) < 0.1 AS DOUBLE) * weight), 6) + 0.0 AS score FROM design JOIN ratio USING (feature_id) GROUP BY subject", RATIO)
def detection_model(spark, d):
    base = ad.design(spark, d)
    return rounded(dz.detection_score(base, dz.class_log_ratio(base, PHI), lambda v: (F.abs(v) < 0.1).cast("double")), "score")


@query(
    "within_class_scatter",
    """SELECT i, j, round(sum(v), 4) + 0.0 AS value FROM (SELECT a.feature_id AS i, b.feature_id AS j, 2 * (count(*) * sum(a.value * b.value) - sum(a.value) * sum(b.value)) AS v
    FROM design a JOIN design b USING (subject) GROUP BY a.label, a.feature_id, b.feature_id) GROUP BY i, j""",
)
def within_class_scatter(spark, d):
    out = dz.within_class_scatter(ad.vectors(spark, d))
    return out.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), (F.round("value", 4) + 0.0).alias("value"))


# ---------------------------------------------------------------- density

KDE = """SELECT a.subject, a.feature_id, sum(exp(-0.5 * pow((a.value - b.value) / h, 2))) / max(n) / (max(h) * sqrt(2 * pi())) AS density FROM design a JOIN design b USING (feature_id)
  JOIN (SELECT feature_id, var_pop(value) * pow(CAST(count(*) AS DOUBLE), CAST(-0.2 AS DOUBLE)) AS h, count(*) AS n FROM design GROUP BY feature_id) USING (feature_id) WHERE h > 0 GROUP BY a.subject, a.feature_id"""


@query("density_at_points", f"SELECT subject, feature_id, {r('density')} FROM ({KDE})")
def density_at_points(spark, d):
    return _ids(rounded(density.density_at_points(ad.design(spark, d)), "density"))


BINNED_CTES = (
    ("bn_stats", "SELECT feature_id, count(*) AS n, var_pop(value) * pow(CAST(count(*) AS DOUBLE), CAST(-0.2 AS DOUBLE)) AS h, min(value) AS x0, (max(value) - min(value)) / 255 AS dx FROM design GROUP BY feature_id HAVING var_pop(value) > 0"),
    ("bn_at", "SELECT subject, feature_id, (value - x0) / dx AS t, least(CAST(floor((value - x0) / dx) AS INT), 254) AS cell FROM design JOIN bn_stats USING (feature_id)"),
    ("bn_w", "SELECT feature_id, cell, sum(w) AS w FROM (SELECT feature_id, cell, 1 - (t - cell) AS w FROM bn_at UNION ALL SELECT feature_id, cell + 1, t - cell FROM bn_at) GROUP BY feature_id, cell"),
    ("bn_d", "SELECT feature_id, node, sum(w * exp(-0.5 * pow((node - cell) * dx / h, 2))) / (max(n) * max(h) * sqrt(2 * pi())) AS d FROM bn_w JOIN bn_stats USING (feature_id), range(256) g(node) GROUP BY feature_id, node"),
)


@query(
    "density_binned",
    "SELECT a.subject, a.feature_id, round(p.d + (t - cell) * (q.d - p.d), 6) + 0.0 AS density FROM bn_at a JOIN bn_d p ON p.feature_id = a.feature_id AND p.node = cell JOIN bn_d q ON q.feature_id = a.feature_id AND q.node = cell + 1",
    *BINNED_CTES,
)
def density_binned(spark, d):
    return _ids(rounded(density.density_binned(ad.design(spark, d), 256), "density"))


GRID = (
    "g",
    """SELECT feature_id, point, x, sum(exp(-0.5 * pow((x - value) / h, 2))) / (max(n) * max(h) * sqrt(2 * pi())) AS density FROM design JOIN (SELECT *, lo + point * (hi - lo) / 19 AS x FROM (
    SELECT feature_id, count(*) AS n, var_pop(value) * pow(CAST(count(*) AS DOUBLE), CAST(-0.2 AS DOUBLE)) AS h, quantile_disc(value, 0.05) AS lo, quantile_disc(value, 0.95) AS hi FROM design GROUP BY feature_id), range(20) r(point) WHERE h > 0) USING (feature_id) GROUP BY feature_id, point, x""",
)


@query("density_on_grid", f"SELECT feature_id, point, {r('x', 'density')} FROM g", GRID)
def density_on_grid(spark, d):
    return _ids(rounded(density.density_on_grid(ad.design(spark, d)), "x", "density")).withColumn("point", F.col("point").cast("long"))


@query(
    "density_lookup",
    f"""SELECT subject, feature_id, {r('density')} FROM (SELECT subject, feature_id, greatest(least(CAST(ceil((value - lo) / ((hi - lo) / 19)) AS BIGINT) - 1, 19), 0) AS point FROM design
    JOIN (SELECT feature_id, min(x) AS lo, max(x) AS hi FROM g GROUP BY feature_id) USING (feature_id)) JOIN g USING (feature_id, point)""",
    GRID,
)
def density_lookup(spark, d):
    base = ad.design(spark, d)
    return _ids(rounded(density.density_lookup(base, density.density_on_grid(base), 20), "density"))


# ---------------------------------------------------------------- evaluation


@query("stratified_folds", "SELECT subject, label, CAST((SELECT max(j) FROM range(8) g(j) WHERE floor(j * n / 8.0) <= rn) AS INT) AS fold FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY subject * 7919 % 10007, subject) - 1 AS rn, count(*) OVER (PARTITION BY label) AS n FROM ids)")
def stratified_folds(spark, d):
    return ev.stratified_folds(ids(spark, d), 8)


@query("loso_folds", "SELECT subject, label, subject AS fold FROM ids")
def loso_folds(spark, d):
    return ev.loso_folds(ids(spark, d))


@query("roc_curve", "SELECT subject, round(score, 6) + 0.0 AS score, round(fp / n_neg, 6) + 0.0 AS fpr, round(tp / n_pos, 6) + 0.0 AS tpr FROM curve")
def roc_curve(spark, d):
    return rounded(ev.roc_curve(ad.scores(spark, d)), "score", "fpr", "tpr")


@query("precision_recall_curve", 'SELECT subject, round(score, 6) + 0.0 AS score, round(tp / (tp + fp), 6) + 0.0 AS "precision", round(tp / n_pos, 6) + 0.0 AS recall FROM curve')
def precision_recall_curve(spark, d):
    return rounded(ev.precision_recall_curve(ad.scores(spark, d)), "score", "precision", "recall")


@query("best_recall", "SELECT round(max(CASE WHEN tp / (tp + fp) >= 0.85 THEN tp / n_pos END), 6) + 0.0 AS best_recall FROM curve")
def best_recall(spark, d):
    return rounded(ev.best_recall(ev.precision_recall_curve(ad.scores(spark, d)), 0.85), "best_recall")


@query("best_precision", "SELECT round(max(CASE WHEN tp / n_pos >= 0.5 THEN tp / (tp + fp) END), 6) + 0.0 AS best_precision FROM curve")
def best_precision(spark, d):
    return rounded(ev.best_precision(ev.precision_recall_curve(ad.scores(spark, d)), 0.5), "best_precision")


@query("auc", "SELECT round(sum(CASE WHEN label <> 1 THEN tp END) / max(n_pos * n_neg), 6) + 0.0 AS auc FROM curve")
def auc(spark, d):
    return rounded(ev.auc(ad.scores(spark, d)), "auc")


@query("pair_score", "SELECT round(won / (won + lost), 6) + 0.0 AS accuracy, round(tied / (won + lost + tied), 6) + 0.0 AS ties FROM (SELECT count(*) FILTER (a.score > b.score) AS won, count(*) FILTER (a.score < b.score) AS lost, count(*) FILTER (a.score = b.score) AS tied FROM scores a JOIN scores b ON a.label = 1 AND b.label = -1)")
def pair_score(spark, d):
    return rounded(ev.pair_score(ad.scores(spark, d)), "accuracy", "ties")


PAIR_CTES = (
    ("ranked", "SELECT subject, label, row_number() OVER (PARTITION BY label ORDER BY subject * 7919 % 10007, subject) - 1 AS rn FROM {source}"),
    ("opposite", """SELECT p.subject AS pos, q.subject AS neg FROM (SELECT DISTINCT k * 7919 % np AS a, k * 104729 % nq AS b FROM range({tries}) g(k),
      (SELECT count(*) FILTER (label = 1) AS np, count(*) FILTER (label = -1) AS nq FROM {source})) JOIN ranked p ON p.label = 1 AND p.rn = a JOIN ranked q ON q.label = -1 AND q.rn = b"""),
)


def pair_ctes(source: str, tries: int) -> tuple:
    return tuple((n, t.format(source=source, tries=tries)) for n, t in PAIR_CTES)


@query("opposite_pairs", "SELECT pos, neg FROM opposite", *pair_ctes("scores", 500))
def opposite_pairs(spark, d):
    return ev.opposite_pairs(ad.scores(spark, d).select("subject", "label"), 500)


PLANE = [(0, 1), (2, 5), (7, 3)]
PLANE_CTES = (
    ("plane_pairs", "SELECT * FROM (VALUES " + ", ".join(f"({a}, {b})" for a, b in PLANE) + ") AS p(f1, f2)"),
    ("plane_uv", "SELECT f1, f2, a.subject, a.value AS u, b.value AS v FROM plane_pairs JOIN design a ON a.feature_id = f1 JOIN design b ON b.feature_id = f2 AND b.subject = a.subject"),
    ("plane_xy", """SELECT f1, f2, u * cos(t) + v * sin(t) AS x, v * cos(t) - u * sin(t) AS y FROM plane_uv JOIN (SELECT f1, f2, atan2(2 * sum(u * v), sum(u * u) - sum(v * v)) / 2 AS t FROM plane_uv GROUP BY f1, f2) USING (f1, f2)"""),
    ("plane_grid", """SELECT f1, f2, count(*) AS n, var_pop(x) * pow(CAST(count(*) AS DOUBLE), -1 / 6.0::DOUBLE) AS hx, var_pop(y) * pow(CAST(count(*) AS DOUBLE), -1 / 6.0::DOUBLE) AS hy,
      quantile_disc(x, 0.05) AS x0, quantile_disc(x, 0.95) AS x1, quantile_disc(y, 0.05) AS y0, quantile_disc(y, 0.95) AS y1 FROM plane_xy GROUP BY f1, f2"""),
)


@query(
    "density_on_plane",
    """SELECT f1 AS first, f2 AS second, i, j, round(gx, 6) + 0.0 AS x, round(gy, 6) + 0.0 AS y, round(sum(exp(-0.5 * pow((gx - x) / hx, 2)) * exp(-0.5 * pow((gy - y) / hy, 2))) / (max(n) * max(hx) * max(hy) * 2 * pi()), 6) + 0.0 AS density
    FROM (SELECT *, x0 + i * (x1 - x0) / 9 AS gx, y0 + j * (y1 - y0) / 9 AS gy FROM plane_grid, range(10) a(i), range(10) b(j)) JOIN plane_xy USING (f1, f2) GROUP BY f1, f2, i, j, gx, gy""",
    *PLANE_CTES,
)
def density_on_plane(spark, d):
    pairs = spark.createDataFrame(PLANE, "first int, second int")
    out = rounded(density.density_on_plane(ad.design(spark, d), pairs), "x", "y", "density")
    return out.withColumns({"i": F.col("i").cast("long"), "j": F.col("j").cast("long")})


SOLID = [[0, 1, 2], [5, 3, 9]]
SOLID_CTES = (
    ("solid_g", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {k}, {f})" for i, g in enumerate(SOLID) for k, f in enumerate(g)) + ") AS s(g, axis, f)"),
    ("solid_v", "SELECT g, axis, subject, value FROM design JOIN solid_g ON f = feature_id"),
    ("solid_q", """SELECT g, axis, quantile_disc(value, 0.05) AS x0, (quantile_disc(value, 0.95) - quantile_disc(value, 0.05)) / 5.0::DOUBLE AS dx,
      var_pop(value) * pow(CAST(count(*) AS DOUBLE), -1 / 7.0::DOUBLE) AS h, count(*) AS n FROM solid_v GROUP BY g, axis"""),
    ("solid_k", "SELECT g, axis, subject, p, exp(-0.5 * pow((x0 + p * dx - value) / h, 2)) / (h * sqrt(2 * pi())) AS k, x0 + p * dx AS x, n FROM solid_v JOIN solid_q USING (g, axis), range(6) r(p)"),
)


@query(
    "density_on_axes",
    """SELECT a.g AS "group", CAST(a.p * 36 + b.p * 6 + c.p AS INT) AS cell, round(max(a.x), 6) + 0.0 AS x, round(max(b.x), 6) + 0.0 AS y, round(max(c.x), 6) + 0.0 AS z, round(sum(a.k * b.k * c.k) / max(a.n), 6) + 0.0 AS density
    FROM solid_k a JOIN solid_k b ON a.g = b.g AND a.subject = b.subject AND a.axis = 0 AND b.axis = 1 JOIN solid_k c ON a.g = c.g AND a.subject = c.subject AND c.axis = 2 GROUP BY a.g, a.p, b.p, c.p""",
    *SOLID_CTES,
)
def density_on_axes(spark, d):
    """Two groups of three features, on their own axes."""
    out = density.density_on_axes(ad.design(spark, d), SOLID, 6, turn=False)
    return rounded(out.select("group", "cell", *[F.col("x")[i].alias(n) for i, n in enumerate("xyz")], "density"), "x", "y", "z", "density")


@query("density_on_principal_axes")
def density_on_principal_axes(spark, d):
    out = density.density_on_axes(ad.design(spark, d), SOLID, 6)
    return rounded(out.select("group", "cell", *[F.col("x")[i].alias(n) for i, n in enumerate("xyz")], "density"), "x", "y", "z", "density")
