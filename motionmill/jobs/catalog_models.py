"""Queries on layers, dictionaries and models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from motionmill import schema
from motionmill.functions import kernels
from motionmill.jobs.catalog import BIN, BINS_SQL, GAUSS, KDE, NUDGE, SCALE, _conv_sql, _kernel_sql, bins, cut, filled, ids, long, nudged, pair_ctes, purity, query, r, regular, rounded, scratch, stored, with_channels
from motionmill.operators import density, design as dz, dictionary as dc, evaluate as ev, frames as fr, layers as ly, models as md, motion, refits as rf, sweep as sw
from motionmill.sources import adapters as ad, tables

BANK = [("gaussian", 8.0), ("derivative", 8.0), ("gaussian", 40.0)]
SCALES = [4.0, 8.0, 16.0]


def lengths(spark) -> DataFrame:
    return schema.stimuli(spark, ad.STIMULI, ad.FPS)


def long_ids(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


SAME = "a.subject = b.subject AND a.stimulus = b.stimulus AND a.channel = b.channel"
BANK_SQL = " UNION ALL ".join(f"SELECT '{n}' AS filter, CAST({s} AS DOUBLE) AS scale, o, w FROM ({_kernel_sql(n, s)})" for n, s in BANK)
BANKED = ("banked", f"SELECT a.subject, a.stimulus, a.channel, filter, scale, a.frame, sum(b.value * w) AS value FROM long a CROSS JOIN bank JOIN long b ON {SAME} AND b.frame = a.frame - o GROUP BY ALL")


@query("filter_bank", f"SELECT subject, stimulus, channel, filter, scale, frame, {r('value')} FROM banked", ("bank", BANK_SQL), BANKED)
def filter_bank(spark, d):
    return rounded(ly.filter_bank(filled(spark, d), ad.CHANNELS, BANK, ad.FPS), "value")


def wide_ctes(scales: list[float]) -> tuple:
    """Averaging kernels and half-overlapping windows of some scales."""
    kern = " UNION ALL ".join(f"SELECT CAST({w} AS DOUBLE) AS wide, o, w FROM ({_kernel_sql('average', w)})" for w in scales)
    bounds = " UNION ALL ".join(
        f"SELECT CAST({w} AS DOUBLE) AS wide, stimulus AS s, i, i * {int(w)} // 2 AS w_begin, least(i * {int(w)} // 2 + {int(w)}, n_frames) AS w_end FROM (SELECT *, unnest(range(greatest(2 * n_frames // {int(w)} - 1, 1))) AS i FROM stimuli)" for w in scales
    )
    return ("wide_k", kern), ("wide_b", bounds)


def second_ctes(scales: list[float], pool: str, source: str = "banked") -> tuple:
    stats = f"""SELECT a.subject, a.stimulus, a.channel, a.filter, a.scale, wide, a.frame, sum(b.value * w) AS mean, sum(b.value * b.value * w) AS square, sum(abs(b.value) * w) AS cumul
      FROM {source} a CROSS JOIN wide_k JOIN {source} b ON {SAME} AND a.filter = b.filter AND a.scale = b.scale AND b.frame = a.frame - o GROUP BY ALL"""
    long_stats = " UNION ALL ".join(f"SELECT subject, stimulus, channel, filter, scale, '{n}' AS stat, wide, frame, {e} AS value FROM wide_s" for n, e in (("mean", "mean"), ("var", "square - mean * mean"), ("cumul", "cumul")))
    pooled = f"""SELECT subject, stimulus, channel, filter, scale, stat, l.wide, CAST(i AS INT) AS "window", {pool}(value) AS value FROM ({long_stats}) l
      JOIN wide_b b ON l.stimulus = b.s AND l.wide = b.wide AND frame >= w_begin AND frame < w_end GROUP BY ALL"""
    return *wide_ctes(scales), ("wide_s", stats), ("second", pooled)


SECOND = f'SELECT subject, stimulus, channel, filter, scale, stat, wide, "window", {r("value")} FROM second'


@query("second_layer", SECOND, ("bank", BANK_SQL), BANKED, *second_ctes([8.0, 16.0], "max"))
def second_layer(spark, d):
    return rounded(ly.second_layer(filled(spark, d), ad.CHANNELS, BANK, [8.0, 16.0], ad.FPS), "value")


HIST_CTES = (
    BINS_SQL, *wide_ctes([8.0, 16.0]),
    ("hot", f"SELECT subject, stimulus, channel, frame, CAST(k AS INT) AS bin, CAST(({BIN}) = k AS DOUBLE) AS value FROM long JOIN bins_t USING (channel), range(5) g(k)"),
    ("hist", f"""SELECT l.subject, l.stimulus, l.channel, bin, l.wide, CAST(i AS INT) AS "window", max(value) AS value FROM (
      SELECT a.subject, a.stimulus, a.channel, a.bin, wide, a.frame, sum(b.value * w) AS value FROM hot a CROSS JOIN wide_k JOIN hot b ON {SAME} AND a.bin = b.bin AND b.frame = a.frame - o GROUP BY ALL) l
      JOIN wide_b b ON l.stimulus = b.s AND l.wide = b.wide AND frame >= w_begin AND frame < w_end GROUP BY ALL"""),
)


def histogram(spark, d) -> DataFrame:
    frames = stored(spark, lambda: filled(spark, d))
    edges = {x["channel"]: list(x["bins"]) for x in bins(spark, d, fr.long_frames(frames, ad.CHANNELS)).collect()}  # four numbers per channel
    return ly.local_histogram(frames, ad.CHANNELS, edges, [8.0, 16.0], ad.FPS)


@query("local_histogram", f'SELECT subject, stimulus, channel, bin, wide, "window", {r("value")} FROM hist', *HIST_CTES)
def local_histogram(spark, d):
    return rounded(histogram(spark, d), "value")


@query("layer", f"SELECT subject, stimulus, channel, 'still' AS filter, 6.0::DOUBLE AS scale, frame, {r('value')} FROM ({_conv_sql('long')})", ("kern", _kernel_sql("still", 6.0)))
def layer(spark, d):
    return rounded(ly.layer("first_layer", filled(spark, d), ad.CHANNELS, [("still", 6.0)], ad.FPS), "value")


MODEL = """SELECT event, k AS cluster, channel, (CASE WHEN channel = 'c1' THEN 0.5 ELSE -0.25 END) * (k + 1) AS centre, m AS mean, s AS std FROM estats, range(2) g(k)"""


def model(spark, d) -> DataFrame:
    stats = fr.event_stats(cut(spark, d)).withColumn("cluster", F.explode(F.array(F.lit(0), F.lit(1))))
    return stats.withColumn("centre", F.when(F.col("channel") == "c1", 0.5).otherwise(-0.25) * (F.col("cluster") + 1))


@query(
    "patterns_response",
    "SELECT subject, stimulus, event, cluster, frame, round(avg(CASE WHEN std > 0 THEN (value - mean) / std ELSE 0 END * centre), 6) + 0.0 AS value FROM long JOIN model USING (channel) GROUP BY subject, stimulus, event, cluster, frame",
    ("model", MODEL),
)
def patterns_response(spark, d):
    return long_ids(rounded(ly.pattern_response(long(spark, d), model(spark, d)), "value"), "cluster")


@query(
    "pattern_response",
    "SELECT subject, stimulus, cluster, frame, round(avg(CASE WHEN std > 0 THEN (value - mean) / std ELSE 0 END * centre), 6) + 0.0 AS value FROM long JOIN model USING (channel) WHERE event = 'e6' GROUP BY subject, stimulus, cluster, frame",
    ("model", MODEL),
)
def pattern_response(spark, d):
    return long_ids(rounded(ly.pattern_response(long(spark, d), model(spark, d).where("event = 'e6'")), "value"), "cluster").drop("event")


CENTRES = [(0, [0.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 1.0]), (3, [1.0, -1.0]), (4, [-1.0, -1.0])]
CENTRES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({k}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for k, (a, b) in CENTRES) + ") AS c(cluster, x, y)"
ASSIGNED = """SELECT subject, event, frame, min_by(cluster, dist) AS cluster FROM (SELECT subject, event, frame, cluster, dist FROM (
  SELECT p.*, cluster, (v1 - x) * (v1 - x) + (v2 - y) * (v2 - y) AS dist FROM (SELECT subject, event, frame, max(CASE WHEN channel = 'c1' THEN value END) AS v1, max(CASE WHEN channel = 'c2' THEN value END) AS v2 FROM ez GROUP BY subject, event, frame) p, centres)
  QUALIFY row_number() OVER (PARTITION BY subject, event, frame ORDER BY dist, cluster) = 1) GROUP BY subject, event, frame"""
CENTRE_CTES = (("centres", CENTRES_SQL), ("assigned", ASSIGNED))


def event_vectors(spark, d) -> DataFrame:
    c = stored(spark, lambda: cut(spark, d))
    z = fr.event_zscore(c, fr.event_stats(c))
    return z.groupBy("subject", "event", "frame").agg(F.array(*[F.max(F.when(F.col("channel") == x, F.col("value"))) for x in ad.CHANNELS]).alias("vector"))


def assigned(spark, d) -> DataFrame:
    return ly.assign_cluster(event_vectors(spark, d), spark.createDataFrame(CENTRES, "cluster int, centre array<double>"))


@query("assign_cluster", "SELECT subject, event, frame, cluster FROM assigned", *CENTRE_CTES)
def assign_cluster(spark, d):
    return assigned(spark, d).select("subject", "event", "frame", "cluster")


@query(
    "cluster_occupancy",
    """SELECT t.subject, t.event, c.cluster, round(coalesce(n, 0) / total, 6) + 0.0 AS share FROM (SELECT subject, event, CAST(count(*) AS DOUBLE) AS total FROM assigned GROUP BY subject, event) t CROSS JOIN centres c
    LEFT JOIN (SELECT subject, event, cluster, count(*) AS n FROM assigned GROUP BY subject, event, cluster) k ON k.subject = t.subject AND k.event = t.event AND k.cluster = c.cluster""",
    *CENTRE_CTES,
)
def cluster_occupancy(spark, d):
    return rounded(ly.cluster_occupancy(assigned(spark, d), ["subject", "event"], len(CENTRES)), "share")


KMEANS_ROUNDS = 4
START_SQL = "(frame * 7919 + subject * 31 + t * 104729) % 10007"


def kmeans_ctes() -> tuple:
    """Four rounds of three tries for each event, then the distortion of each try."""
    points = ("points", "SELECT subject, event, frame, max(value) FILTER (channel = 'c1') AS x, max(value) FILTER (channel = 'c2') AS y FROM ez GROUP BY subject, event, frame")
    out = [points, ("km0", f"SELECT event, t, row_number() OVER (PARTITION BY event, t ORDER BY {START_SQL}, subject, frame) - 1 AS k, x, y FROM points, range(3) g(t) QUALIFY k < 3")]
    near = "SELECT p.event, t, p.subject, p.frame, p.x, p.y, k, (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) AS d FROM points p JOIN km{i} c ON p.event = c.event QUALIFY row_number() OVER (PARTITION BY p.event, t, p.subject, p.frame ORDER BY d, k) = 1"
    for i in range(KMEANS_ROUNDS):
        out.append((f"km{i + 1}", f"SELECT event, t, row_number() OVER (PARTITION BY event, t ORDER BY k) - 1 AS k, x, y FROM (SELECT event, t, k, avg(x) AS x, avg(y) AS y FROM ({near.format(i=i)}) GROUP BY event, t, k)"))
    last = KMEANS_ROUNDS
    out.append(("km_cost", f"SELECT event, t, sum(d) AS cost FROM ({near.format(i=last)}) GROUP BY event, t"))
    out.append(("km_best", f"SELECT event, k, x, y FROM km{last} JOIN (SELECT event, t FROM km_cost QUALIFY row_number() OVER (PARTITION BY event ORDER BY cost, t) = 1) USING (event, t)"))
    return tuple(out)


@query("kmeans", "SELECT event, CAST(k AS INT) AS cluster, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM km_best", *kmeans_ctes())
def kmeans(spark, d):
    """Three tries of all events in one loop, from given starts."""
    v = stored(spark, lambda: event_vectors(spark, d))
    draws = v.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("t"))
    place = (F.col("frame") * 7919 + F.col("subject") * 31 + F.col("t") * 104729) % 10007
    first = F.row_number().over(W.partitionBy("event", "t").orderBy(place, "subject", "frame"))
    starts = draws.withColumn("rn", first).where("rn <= 3").select("event", "t", "rn", "vector")
    c = md.kmeans(v, 3, rounds=KMEANS_ROUNDS, tol=-1.0, by=["event"], starts=starts)
    return rounded(c.select("event", "cluster", F.col("centre")[0].alias("x"), F.col("centre")[1].alias("y")), "x", "y")


# ---------------------------------------------------------------- dictionary


LEVELS = 6  # of the padded series, 64 places
REFLECTED = """SELECT subject, stimulus, channel, CAST(place AS INT) AS place, CASE WHEN t < 0 THEN 2 * x0 - v WHEN t >= n THEN 2 * x1 - v ELSE v END AS value FROM (
  SELECT e.*, l.value AS v FROM (SELECT subject, stimulus, channel, n, x0, x1, place, place - {begin} AS t, CASE WHEN place - {begin} < 0 THEN {begin} - place WHEN place - {begin} >= n THEN 2 * (n - 1) - place + {begin} ELSE place - {begin} END AS src
    FROM (SELECT subject, stimulus, channel, count(*) AS n, arg_min(value, frame) AS x0, arg_max(value, frame) AS x1 FROM long GROUP BY subject, stimulus, channel), range({size}) g(place)) e
  JOIN long l ON l.subject = e.subject AND l.stimulus = e.stimulus AND l.channel = e.channel AND l.frame = e.src)"""
PADDED = ("padded", REFLECTED.format(begin="((64 - n) // 2)", size="64"))


def wavelet_ctes() -> tuple:
    """One table of means and details for each level; ``levels`` holds all coefficients."""
    taps = ("taps", "SELECT * FROM (VALUES " + ", ".join(f"({k}, CAST({float(dc.LOW[k])!r} AS DOUBLE), CAST({float(dc.HIGH[k])!r} AS DOUBLE))" for k in range(4)) + ") AS t(k, low, high)")
    out, source, n = [PADDED, taps], "SELECT subject, stimulus, channel, place, value AS mean FROM padded", 64
    for level in range(LEVELS):
        at = f"((place - k + 4 * {n}) % {n})"
        out.append((f"level{level}", f"SELECT subject, stimulus, channel, CAST({at} // 2 AS INT) AS place, sum(low * mean) AS mean, sum(high * mean) AS detail FROM ({source}), taps WHERE {at} % 2 = 0 GROUP BY ALL"))
        source, n = f"SELECT subject, stimulus, channel, place, mean FROM level{level}", n // 2
    parts = [f"SELECT subject, stimulus, channel, {k} AS level, place, detail AS coef FROM level{k}" for k in range(LEVELS)]
    return *out, ("levels", " UNION ALL ".join([*parts, f"SELECT subject, stimulus, channel, {LEVELS}, place, mean FROM level{LEVELS - 1}"]))


@query("wavelet_transform", f"SELECT subject, stimulus, channel, level, place, {r(f'coef + {NUDGE} AS coef')} FROM levels", *wavelet_ctes())
def wavelet_transform(spark, d):
    return nudged(dc.wavelet_transform(filled(spark, d), ad.CHANNELS), "coef")


@query(
    "wavelet_blinded",
    "SELECT subject, stimulus, channel, level, count(*) AS n, count(*) FILTER (known) AS known FROM seen GROUP BY subject, stimulus, channel, level",
    *((n, t.replace("FROM long", "FROM gaps").replace("JOIN long", "JOIN gaps").replace("arg_min(value, frame)", "arg_min(value, frame) FILTER (frame = 0)").replace("arg_max(value, frame)", "arg_max(value, frame) FILTER (frame = n_frames - 1)").replace("FROM gaps GROUP BY subject, stimulus, channel)", "FROM gaps JOIN stimuli USING (stimulus) GROUP BY subject, stimulus, channel)")
       .replace("sum(low * mean) AS mean, sum(high * mean) AS detail", "CASE WHEN count(mean) = 4 THEN sum(low * mean) END AS mean, CASE WHEN count(mean) = 4 THEN sum(high * mean) END AS detail")) for n, t in wavelet_ctes()),
    ("seen", "SELECT subject, stimulus, channel, level, coef IS NOT NULL AS known FROM levels"),
)
def wavelet_blinded(spark, d):
    """Missing frames stay missing: coefficients of each level, and how many of them no gap reaches."""
    coefs = dc.wavelet_transform(with_channels(regular(spark, d)), ad.CHANNELS)
    return coefs.groupBy("subject", "stimulus", "channel", "level").agg(F.count(F.lit(1)).alias("n"), F.count("coef").alias("known"))


@query("inverse_wavelet", f"SELECT subject, stimulus, channel, frame, {r('value')} FROM long")
def inverse_wavelet(spark, d):
    return rounded(dc.wavelet_round_trip(filled(spark, d), ad.CHANNELS), "value")


@query("time_frequency", f"SELECT subject, stimulus, channel, level, CAST(place * pow(2, level + 1) + i AS INT) AS frame, {r(f'coef + {NUDGE} AS coef')} FROM levels, range(64) g(i) WHERE level < {LEVELS} AND i < pow(2, level + 1)", *wavelet_ctes())
def time_frequency(spark, d):
    return nudged(dc.time_frequency(dc.wavelet_transform(filled(spark, d), ad.CHANNELS)), "coef")


@query("shrink", "SELECT subject, stimulus, channel, frame, round(value * greatest(1 - 5 / greatest(abs(value), 1e-7), 0), 6) + 0.0 AS soft, round(CASE WHEN abs(value) > 5 THEN value ELSE 0 END, 6) + 0.0 AS hard FROM long")
def shrink(spark, d):
    v = F.col("value")
    return rounded(long(spark, d).select("subject", "stimulus", "channel", "frame", dc.shrink(v, 5.0).alias("soft"), dc.shrink(v, 5.0, soft=False).alias("hard")), "soft", "hard")


@query("wavelet_inpaint")
def wavelet_inpaint(spark, d):
    return rounded(dc.wavelet_inpaint(with_channels(regular(spark, d)), ad.CHANNELS, 1.0), "value")


ATOM_SQL = " UNION ALL ".join(f"SELECT 'gaussian' AS atom, {k} AS scale_idx, CAST({s} AS DOUBLE) AS scale, o, w FROM ({_kernel_sql('gaussian', s, 1.0, 2.0)})" for k, s in enumerate(SCALES))
SPACE_CTES = (("atoms", ATOM_SQL), ("space", f"SELECT a.subject, a.stimulus, a.channel, atom, scale_idx, scale, a.frame, sum(b.value * w) AS value FROM long a CROSS JOIN atoms JOIN long b ON {SAME} AND b.frame = a.frame + o GROUP BY ALL"))


@query("dictionary_transform", f"SELECT subject, stimulus, channel, atom, scale_idx, scale, frame, {r('value')} FROM space", *SPACE_CTES)
def dictionary_transform(spark, d):
    return rounded(dc.dictionary_transform(filled(spark, d), ad.CHANNELS, ["gaussian"], SCALES, ad.FPS), "value")


MASKED = ("masked", f"""SELECT a.subject, a.stimulus, a.channel, atom, scale_idx, scale, a.frame, coalesce(sum(b.value * w), 0) AS v, coalesce(sum(w) FILTER (b.value IS NOT NULL), 0) AS k, count(b.value) AS m
  FROM gaps a CROSS JOIN atoms JOIN gaps b ON {SAME} AND b.frame = a.frame + o GROUP BY ALL""")


@query(
    "dictionary_transform_masked",
    f"""SELECT subject, stimulus, channel, mode, scale_idx, frame, {r('value')} FROM (
      SELECT *, 'weight' AS mode, v / CASE WHEN k < 0.01 THEN 1 ELSE k END AS value FROM masked UNION ALL SELECT *, 'receptive', v / CASE WHEN m < 0.01 THEN 1 ELSE m END FROM masked)""",
    SPACE_CTES[0], MASKED,
)
def dictionary_transform_masked(spark, d):
    """Series with gaps: sums over known frames, by their weights or by their number."""
    gaps, out = stored(spark, lambda: with_channels(regular(spark, d))), None
    for mode in ("weight", "receptive"):
        one = dc.dictionary_transform(gaps, ad.CHANNELS, ["gaussian"], SCALES, ad.FPS, mode).select("subject", "stimulus", "channel", F.lit(mode).alias("mode"), "scale_idx", "frame", "value")
        out = one if out is None else out.unionByName(one)
    return rounded(out, "value")


@query("pursuit_masked")
def pursuit_masked(spark, d):
    """Atoms of series with gaps, fitted to the known frames."""
    return rounded(dc.pursuit(with_channels(regular(spark, d)), ad.CHANNELS, ["gaussian"], SCALES, ad.FPS, rounds=4, mode="weight"), "amp")


@query(
    "convolve_reflected",
    f"""SELECT a.subject, a.stimulus, a.channel, a.frame, round(sum(b.value * w), 6) + 0.0 AS value FROM long a CROSS JOIN kern JOIN padded b ON {SAME} AND b.place - 4 = a.frame - o GROUP BY a.subject, a.stimulus, a.channel, a.frame""",
    GAUSS, ("padded", REFLECTED.format(begin="4", size="58").replace("e.*, l.value", "e.*, l.value").replace("range(58) g(place)) e", "range(58) g(place) WHERE place < n + 8) e")),
)
def convolve_reflected(spark, d):
    return rounded(dc.convolve_reflected(filled(spark, d), ad.CHANNELS, "gaussian", SCALE, ad.FPS), "value")


DOUBLE = ("twice", f"SELECT subject, stimulus, channel, frame, value FROM ({_conv_sql('long', 'value')})")


@query("dictionary_inverse", f"SELECT subject, stimulus, channel, frame, {r('value')} FROM ({_conv_sql('twice')})", ("kern", _kernel_sql("gaussian", 8.0, 1.0, 2.0)), DOUBLE)
def dictionary_inverse(spark, d):
    return rounded(dc.dictionary_inverse(filled(spark, d), ad.CHANNELS, ["gaussian"], [8.0], ad.FPS), "value")


@query("dictionary_inpaint")
def dictionary_inpaint(spark, d):
    return rounded(dc.dictionary_inpaint(with_channels(regular(spark, d)), ad.CHANNELS, ["gaussian"], SCALES, ad.FPS, 0.5), "value")


AROUND = """SELECT *, lag(a) OVER k AS up, lead(a) OVER k AS down, lag(l) OVER k AS up_l, lead(r) OVER k AS down_r, lead(l) OVER k AS down_l, lag(r) OVER k AS up_r, max(a) OVER (PARTITION BY subject, stimulus, channel) AS top FROM (
  SELECT *, lag(a) OVER t AS l, lead(a) OVER t AS r FROM (SELECT *, abs(round(value, 9)) AS a FROM space) WINDOW t AS (PARTITION BY subject, stimulus, channel, scale_idx ORDER BY frame))
  WINDOW k AS (PARTITION BY subject, stimulus, channel, frame ORDER BY scale_idx)"""


@query(
    "scale_space_maxima",
    f"""SELECT subject, stimulus, channel, scale_idx, scale, frame, {r('value')} FROM around WHERE a > 0 AND a >= 0.3 * top AND coalesce(a > l, true) AND coalesce(a >= r, true) AND coalesce(a > up, true) AND coalesce(a >= down, true)
    AND coalesce(a > up_l, true) AND coalesce(a >= down_r, true) AND coalesce(a > down_l, true) AND coalesce(a >= up_r, true)""",
    *SPACE_CTES, ("around", AROUND),
)
def scale_space_maxima(spark, d):
    return rounded(dc.scale_space_maxima(filled(spark, d), ad.CHANNELS, "gaussian", SCALES, ad.FPS, 0.3), "value")


MAXIMA = """SELECT * FROM around WHERE a > 0 AND a >= {thres} * top AND coalesce(a > l, true) AND coalesce(a >= r, true) AND coalesce(a > up, true) AND coalesce(a >= down, true)
    AND coalesce(a > up_l, true) AND coalesce(a >= down_r, true) AND coalesce(a > down_l, true) AND coalesce(a >= up_r, true)"""
#: Maxima of a series as (scale, frame, value), then kept ones with where their run began; a near one joins the last run.
RUNS = f"""SELECT subject, stimulus, channel, unnest(list_reduce(list_prepend(CAST([] AS DOUBLE[][]), list([[CAST(scale_idx AS DOUBLE), CAST(frame AS DOUBLE), value, scale]] ORDER BY scale_idx, frame)), lambda acc, m:
    CASE WHEN len(acc) > 0 AND abs(m[1][2] - acc[-1][5]) < m[1][4] * {ad.FPS} THEN CASE WHEN abs(m[1][3]) > abs(acc[-1][3]) THEN list_append(acc[:-2], list_append(m[1], acc[-1][5])) ELSE acc END
    ELSE list_append(acc, list_append(m[1], m[1][2])) END)) AS kept FROM found GROUP BY subject, stimulus, channel"""


@query(
    "separate_maxima",
    f"SELECT subject, stimulus, channel, CAST(kept[1] AS INT) AS scale_idx, kept[4] AS scale, CAST(kept[2] AS INT) AS frame, {r('kept[3] AS value')} FROM runs",
    *SPACE_CTES, ("around", AROUND), ("found", MAXIMA.format(thres=0.3)), ("runs", RUNS),
)
def separate_maxima(spark, d):
    return rounded(dc.scale_space_maxima(filled(spark, d), ad.CHANNELS, "gaussian", SCALES, ad.FPS, 0.3, apart=True), "value")


@query("pursuit")
def pursuit(spark, d):
    return rounded(dc.pursuit(filled(spark, d), ad.CHANNELS, ["gaussian"], SCALES, ad.FPS, rounds=4), "amp")


PLACED = """SELECT subject, stimulus, channel, 'gaussian' AS atom, frame % 3 AS scale_idx, CASE frame % 3 WHEN 0 THEN 4.0::DOUBLE WHEN 1 THEN 8.0::DOUBLE ELSE 16.0::DOUBLE END AS scale, frame AS pos, value AS amp FROM (
  SELECT *, abs(value) AS a, lag(abs(value)) OVER o AS b, lead(abs(value)) OVER o AS c, max(abs(value)) OVER (PARTITION BY subject, stimulus, channel) AS top FROM long
  WINDOW o AS (PARTITION BY subject, stimulus, channel ORDER BY frame)) WHERE (b IS NULL OR a >= b) AND (c IS NULL OR a > c) AND a >= 0.5 * top"""
SPREAD = """SELECT p.subject, p.stimulus, p.channel, p.scale_idx, pos, pos + o AS frame, amp, w FROM spots p JOIN atoms USING (atom, scale_idx) JOIN stimuli USING (stimulus) WHERE pos + o >= 0 AND pos + o < n_frames"""
PLACED_CTES = (("atoms", ATOM_SQL), ("spots", PLACED), ("spread", SPREAD))


def placed(spark, d) -> DataFrame:
    """An atom at each local maximum, its scale dealt by the frame."""
    top = motion.local_maxima(long(spark, d), 0.5)
    k = (F.col("frame") % 3).cast("int")
    return top.select("subject", "stimulus", "channel", F.lit("gaussian").alias("atom"), k.alias("scale_idx"), F.get(F.array(*[F.lit(s) for s in SCALES]), k).alias("scale"), F.col("frame").alias("pos"), F.col("value").alias("amp"))


@query("distinct_atoms", "SELECT subject, stimulus, channel, atom, scale_idx, pos FROM spots", *PLACED_CTES[:2])
def distinct_atoms(spark, d):
    both = placed(spark, d)
    return dc.distinct_atoms(both.unionByName(both)).select("subject", "stimulus", "channel", "atom", "scale_idx", "pos")


@query("rebuild_signal", f"SELECT subject, stimulus, channel, frame, {r('sum(amp * w) AS value')} FROM spread GROUP BY subject, stimulus, channel, frame", *PLACED_CTES)
def rebuild_signal(spark, d):
    return rounded(dc.rebuild_signal(placed(spark, d), lengths(spark), ad.FPS), "value")


#: Words of 16 numbers: a hump, a step and a wave.
WORDS = [[round(float(x), 6) for x in w] for w in (np.exp(-np.linspace(-2, 2, 16) ** 2), np.where(np.arange(16) < 7, -0.5, 1.0), np.sin(np.arange(16) / 2.0))]
WORD_CTES = (
    ("word_t", " UNION ALL ".join(f"SELECT {k} AS cluster, {w!r}::DOUBLE[] AS word" for k, w in enumerate(WORDS))),
    ("word_k", " UNION ALL ".join(f"""SELECT cluster, CAST({s} AS DOUBLE) AS scale, o, word[CAST(floor(p) AS INT) + 1] + (word[CAST(least(floor(p) + 1, 15) AS INT) + 1] - word[CAST(floor(p) AS INT) + 1]) * (p - floor(p)) AS w
      FROM (SELECT *, (o + {kernels.half_width(s, ad.FPS)}) * 15 / (2.0::DOUBLE * {kernels.half_width(s, ad.FPS)}) AS p FROM word_t, range(-{kernels.half_width(s, ad.FPS)}, {kernels.half_width(s, ad.FPS)} + 1) g(o))""" for s in SCALES)),
)


@query(
    "rebuild_from_words",
    f"SELECT subject, stimulus, channel, CAST(frame AS INT) AS frame, {r(f'sum(amp * w) + {NUDGE} AS value')} FROM (SELECT p.*, pos + o AS frame, w FROM (SELECT *, (pos + stimulus) % 3 AS cluster FROM spots) p JOIN word_k USING (cluster, scale)) JOIN stimuli USING (stimulus) WHERE frame >= 0 AND frame < n_frames GROUP BY subject, stimulus, channel, frame",
    *PLACED_CTES[:2], *WORD_CTES,
)
def rebuild_from_words(spark, d):
    """A word of three at each local maximum, its scale and word dealt by the frame."""
    found = placed(spark, d).withColumn("cluster", ((F.col("pos") + F.col("stimulus")) % 3).cast("int"))
    words = spark.createDataFrame([(k, w) for k, w in enumerate(WORDS)], "cluster int, word array<double>")
    return nudged(dc.rebuild_from_words(found, words, lengths(spark), SCALES, ad.FPS), "value")


#: Sixteen places across the window of each maximum, held inside the series, and the line between the frames around each.
PATTERN_CTES = (
    ("found", MAXIMA.format(thres=0.5)),
    ("spans", """SELECT subject, stimulus, channel, scale, frame AS pos, value AS amp, k, greatest(least(frame - h + k * 2 * h / 15.0::DOUBLE, n_frames - 1), 0) AS p
      FROM (SELECT *, CAST(floor(scale / 2) AS INT) AS h FROM found) JOIN stimuli USING (stimulus), range(16) g(k)"""),
    ("mined", """SELECT s.subject, s.stimulus, s.channel, scale, pos, amp, CAST(k AS INT) AS place, (a.value + coalesce(b.value - a.value, 0) * (p - floor(p))) / amp AS value FROM spans s
      JOIN long a ON a.subject = s.subject AND a.stimulus = s.stimulus AND a.channel = s.channel AND a.frame = CAST(floor(p) AS INT)
      LEFT JOIN long b ON b.subject = s.subject AND b.stimulus = s.stimulus AND b.channel = s.channel AND b.frame = CAST(floor(p) AS INT) + 1"""),
)


@query("mine_patterns", f"SELECT subject, stimulus, channel, scale, pos, {r(f"amp + {NUDGE} AS amp")}, place, round(value + {NUDGE}, 5) + 0.0 AS value FROM mined", *SPACE_CTES, ("around", AROUND), *PATTERN_CTES)
def mine_patterns(spark, d):
    """The signal around each scale-space maximum, a row for each of its sixteen places."""
    found = dc.mine_patterns(filled(spark, d), ad.CHANNELS, "gaussian", SCALES, ad.FPS, 0.5)
    out = found.select("subject", "stimulus", "channel", "scale", "pos", "amp", F.posexplode("pattern").alias("place", "value"))
    return nudged(out, "amp").withColumn("value", F.round(F.col("value") + NUDGE, 5) + 0.0)


@query("mine_patterns_masked")
def mine_patterns_masked(spark, d):
    found = dc.mine_patterns(with_channels(regular(spark, d)), ad.CHANNELS, "gaussian", SCALES, ad.FPS, 0.5, mode="weight")
    out = found.select("subject", "stimulus", "channel", "scale", "pos", "amp", F.posexplode("pattern").alias("place", "value"))
    return nudged(out, "amp").withColumn("value", F.round(F.col("value") + NUDGE, 5) + 0.0)


PATTERN_KEY = "subject, stimulus, channel, scale, pos"


def pattern_kmeans_ctes(rounds: int = 3, k: int = 4) -> tuple:
    """Two tries on whole patterns; after the rounds, the cluster of every pattern in the better one."""
    drawn = "(subject * 31 + pos * 7919 + stimulus * 131 + t * 104729) % 10007"
    out = [("pat", f"SELECT {PATTERN_KEY}, list(value ORDER BY place) AS v FROM mined GROUP BY ALL"),
           ("pk0", f"SELECT t, row_number() OVER (PARTITION BY t ORDER BY {drawn}, {PATTERN_KEY}) - 1 AS k, v AS c FROM pat, range(2) g(t) QUALIFY k < {k}")]
    for i in range(rounds + 1):
        out.append((f"pn{i}", f"SELECT t, {PATTERN_KEY}, v, k, list_sum(list_transform(v, lambda x, i: (x - c[i]) * (x - c[i]))) AS d FROM pat, pk{i} QUALIFY row_number() OVER (PARTITION BY t, {PATTERN_KEY} ORDER BY d, k) = 1"))
        if i < rounds:
            out.append((f"pk{i + 1}", f"SELECT t, row_number() OVER (PARTITION BY t ORDER BY k) - 1 AS k, list(m ORDER BY i) AS c FROM (SELECT t, k, i, avg(v[i]) AS m FROM pn{i}, range(1, 17) g(i) GROUP BY t, k, i) GROUP BY t, k"))
    return (*out, ("pat_best", f"SELECT t FROM pn{rounds} GROUP BY t ORDER BY sum(d), t LIMIT 1"), ("pat_near", f"SELECT * FROM pn{rounds} JOIN pat_best USING (t)"))


@query("cluster_patterns", f"SELECT {PATTERN_KEY}, CAST(k AS INT) AS cluster FROM pat_near", *SPACE_CTES, ("around", AROUND), *PATTERN_CTES, *pattern_kmeans_ctes())
def cluster_patterns(spark, d):
    """The word of every mined pattern, from given starts."""
    keys = ["subject", "stimulus", "channel", "scale", "pos"]
    found = stored(spark, lambda: dc.mine_patterns(filled(spark, d), ad.CHANNELS, "gaussian", SCALES, ad.FPS, 0.5).withColumnRenamed("pattern", "vector"))
    place = (F.col("subject") * 31 + F.col("pos") * 7919 + F.col("stimulus") * 131 + F.col("t") * 104729) % 10007
    draws = found.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("t"))
    starts = draws.withColumn("rn", F.row_number().over(W.partitionBy("t").orderBy(place, *keys))).where("rn <= 4").select("t", "rn", "vector")
    return ly.assign_cluster(found, md.kmeans(found, 4, rounds=3, tol=-1.0, starts=starts)).select(*keys, "cluster")


# ---------------------------------------------------------------- models


def queried(spark, d) -> DataFrame:
    """The stated query set of searches: every row whose id is divisible by 20."""
    return ad.vectors(spark, d).where(F.col("subject") % 20 == 0)


PAIRS = "SELECT a.subject AS query, b.subject, sum((a.value - b.value) * (a.value - b.value)) AS dist, max(a.label) AS own, max(b.label) AS label FROM design a JOIN design b USING (feature_id) WHERE a.subject % 20 = 0 GROUP BY a.subject, b.subject"


@query("pairwise_distance", f"SELECT query, subject, label, {r('dist AS value')} FROM pairs", ("pairs", PAIRS))
def pairwise_distance(spark, d):
    return rounded(md.pairwise(queried(spark, d), ad.vectors(spark, d)), "value")


@query(
    "similarity_kernels",
    "SELECT a.subject AS query, b.subject, round(pow(1 + sum(a.value * b.value), 2), 5) + 0.0 AS poly, round(exp(-sum((a.value - b.value) * (a.value - b.value)) / 2.0), 6) + 0.0 AS rbf FROM design a JOIN design b USING (feature_id) WHERE a.subject % 20 = 0 GROUP BY a.subject, b.subject",
)
def similarity_kernels(spark, d):
    met = md.measures(queried(spark, d), ad.vectors(spark, d), {"poly": md.poly_kernel, "dist": md.squared_distance})
    return met.select("query", "subject", (F.round("poly", 5) + 0.0).alias("poly"), (F.round(F.exp(-F.col("dist") / 2.0), 6) + 0.0).alias("rbf"))


@query("knn_score", "SELECT query, round(avg(label), 6) + 0.0 AS score FROM (SELECT * FROM pairs WHERE query <> subject QUALIFY row_number() OVER (PARTITION BY query ORDER BY dist, subject) <= 8) GROUP BY query", ("pairs", PAIRS))
def knn_score(spark, d):
    return rounded(md.knn_score(queried(spark, d), ad.vectors(spark, d), 8), "score")


@query(
    "margin_triplets",
    "SELECT a.query, CAST(count(*) AS BIGINT) AS n, round(sum(1 + a.dist - b.dist), 4) + 0.0 AS loss FROM pairs a JOIN pairs b ON a.query = b.query AND a.label = a.own AND b.label <> b.own AND a.subject <> a.query AND 1 + a.dist - b.dist > 0 GROUP BY a.query",
    ("pairs", PAIRS),
)
def margin_triplets(spark, d):
    out = md.margin_triplets(queried(spark, d), ad.vectors(spark, d)).where("n > 0")
    return out.withColumn("loss", F.round("loss", 4) + 0.0)


def constant(v: DataFrame) -> DataFrame:
    return v.withColumn("vector", F.concat("vector", F.array(F.lit(1.0))))


def targets(v: DataFrame) -> DataFrame:
    return v.join(dz.weight_labels(v.select("subject", "label")).select("subject", "target"), "subject")


@query("linear_svm")
def linear_svm(spark, d):
    v = constant(ad.vectors(spark, d))
    w = md.linear_svm(ad.vectors(spark, d), 0.01)
    return md.linear_score(v, w).select("subject", "label", F.round("score", 3).alias("score"))


GENERATIVE_CTES = (
    ("gm_grid", "SELECT feature_id, lo - (hi - lo) / 2 + point * 2 * (hi - lo) / 49 AS x, 2 * (hi - lo) / 49 AS dx, point FROM (SELECT feature_id, min(value) AS lo, max(value) AS hi FROM design GROUP BY feature_id), range(50) g(point) WHERE hi > lo"),
    ("gm_width", "SELECT feature_id, label, greatest(var_pop(value), 1e-12) * pow(CAST(count(*) AS DOUBLE), -0.2::DOUBLE) AS h, count(*) AS n FROM design GROUP BY feature_id, label"),
    ("gm_p", """SELECT feature_id, label, point, max(x) AS x, max(dx) AS dx, sum(exp(-0.5 * pow((x - value) / h, 2))) / (max(h) * max(n) * sqrt(2 * pi())) AS p FROM design JOIN gm_width USING (feature_id, label) JOIN gm_grid USING (feature_id) GROUP BY feature_id, label, point"""),
    ("gm_both", "SELECT feature_id, point, max(x) AS x, max(dx) AS dx, coalesce(sum(p) FILTER (label = 1), 0) AS p1, coalesce(sum(p) FILTER (label <> 1), 0) AS p0 FROM gm_p GROUP BY feature_id, point"),
    ("gm", "SELECT feature_id, point, x, ln((p1 + 1e-9) / (p0 + 1e-9)) AS ratio FROM gm_both WHERE feature_id IN (SELECT feature_id FROM gm_both WHERE point > 0 GROUP BY feature_id HAVING sum(dx * abs(p1 - p0)) > 0.1)"),
)


@query(
    "generative_model",
    """SELECT subject, round(sum(ratio), 6) + 0.0 AS score FROM (SELECT subject, feature_id, greatest(least(CAST(ceil((value - lo) / ((hi - lo) / 49)) AS BIGINT) - 1, 49), 0) AS point FROM design
    JOIN (SELECT feature_id, min(x) AS lo, max(x) AS hi FROM gm GROUP BY feature_id) USING (feature_id)) JOIN gm USING (feature_id, point) GROUP BY subject""",
    *GENERATIVE_CTES,
)
def generative_model(spark, d):
    base = ad.design(spark, d)
    return rounded(md.generative_score(base, md.generative_model(base, 50, 0.1), 50), "score")


SMOOTH_CTES = (
    *GENERATIVE_CTES[:3], ("smooth_k", _kernel_sql("gaussian", 50 / density.SMOOTHING, density.SMOOTHING_FPS)),
    ("gs_p", "SELECT a.feature_id, a.label, a.point, max(a.x) AS x, max(a.dx) AS dx, sum(b.p * w) AS p FROM gm_p a, smooth_k k JOIN gm_p b ON true WHERE b.feature_id = a.feature_id AND b.label = a.label AND b.point = a.point - o GROUP BY a.feature_id, a.label, a.point"),
    ("gs_n", "SELECT feature_id, label, point, x, dx, p / sum(dx * p) FILTER (point > 0) OVER (PARTITION BY feature_id, label) AS p FROM gs_p"),
    ("gs_both", GENERATIVE_CTES[3][1].replace("FROM gm_p", "FROM gs_n")), ("gs", GENERATIVE_CTES[4][1].replace("gm_both", "gs_both")),
)


@query("generative_model_smoothed", f"SELECT feature_id, CAST(point AS INT) AS point, {r('x', 'ratio')} FROM gs", *SMOOTH_CTES)
def generative_model_smoothed(spark, d):
    """The model's log ratios on its grid, from densities smoothed along it."""
    return long_ids(rounded(md.generative_model(ad.design(spark, d), 50, 0.1, smooth=True), "x", "ratio"), "feature_id")


@query("chi_similarity", "SELECT a.subject AS query, b.subject, round(sum(abs(a.value) * abs(b.value) / nullif(abs(a.value) + abs(b.value), 0)), 6) + 0.0 AS chi FROM design a JOIN design b USING (feature_id) WHERE a.subject % 20 = 0 GROUP BY a.subject, b.subject")
def chi_similarity(spark, d):
    """The chi kernel of sizes, for the stated query set."""
    size = lambda v: v.withColumn("vector", F.transform("vector", F.abs))
    out = md.pairwise(size(queried(spark, d)), size(ad.vectors(spark, d)), md.chi_kernel)
    return rounded(out.select("query", "subject", F.col("value").alias("chi")), "chi")


@query("metric_learning")
def metric_learning(spark, d):
    """A metric learned from the triplets of all rows, a fifth in each of five rounds; the stated query set scored under it."""
    v = stored(spark, lambda: ad.vectors(spark, d))
    s, _ = md.metric_learning(v, rounds=5, parts=5)
    return rounded(md.metric_score(v.where(F.col("subject") % 20 == 0), v, s), "score")


@query("purity_tree")
def purity_tree(spark, d):
    return rounded(md.tree_score(ad.vectors(spark, d), md.purity_tree(ad.design(spark, d))), "score")


@query("linear_tree")
def linear_tree(spark, d):
    """A tree whose nodes split by the sign of a linear fit on their best features."""
    design = stored(spark, lambda: ad.design(spark, d))
    return rounded(md.tree_score(ad.vectors(spark, d), md.purity_tree(design, split=md.linear_split(16))), "score")


# ---------------------------------------------------------------- evaluation by refits

#: Linear classifiers, and settings of the seven families of the sweep.
GRID = [("ridge", "gamma", 0.1), ("ridge", "gamma", 10.0), ("pursuit", "m", 8.0), ("lasso", "gamma", 0.01), ("elimination", "keep", 20.0), ("least_squares", "gamma", 0.0)]
FAMILIES = [
    ("sparse", "gamma", 0.005), ("sparse", "gamma", 0.02), ("pursuit", "m", 8.0), ("elimination", "keep", 20.0), ("svm", "gamma", 0.1), ("svm", "gamma", 1.0),
    ("knn", "k", 2.0), ("knn", "k", 8.0), ("generative", "thres", 0.1), ("generative", "thres", 0.2), ("detection", "top", 16.0),
]


def folds(spark, d, k: int = 4) -> DataFrame:
    return ev.stratified_folds(ids(spark, d), k)


def cohort(spark, d) -> sw.Cohort:
    return sw.Cohort(ad.vectors(spark, d), ad.design(spark, d), densities(spark, d))


@query("cross_evaluate")
def cross_evaluate(spark, d):
    """Mean areas of every setting of the seven families, by fold."""
    return rounded(rf.fold_scores(sw.fold_predictions(cohort(spark, d), stored(spark, lambda: folds(spark, d)), FAMILIES)), "score")


FOLD_SQL = """SELECT subject, label, CAST((SELECT max(j) FROM range(4) g(j) WHERE floor(j * n / 4.0) <= rn) AS INT) AS fold FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY subject * 7919 % 10007, subject) - 1 AS rn, count(*) OVER (PARTITION BY label) AS n FROM ids)"""
PURE_CTES = (
    ("fold_t", FOLD_SQL), ("outside", "SELECT d.*, CAST(k AS BIGINT) AS k FROM design d JOIN fold_t f USING (subject), range(4) g(k) WHERE k <> fold"),
    ("fold_pure", """SELECT k AS fold, feature_id, greatest(avg(CASE WHEN rn <= tenth THEN CAST(label = 1 AS DOUBLE) END), avg(CASE WHEN rn > n - tenth THEN CAST(label = 1 AS DOUBLE) END)) AS score
      FROM (SELECT *, greatest(n // 10, 1) AS tenth FROM (SELECT *, row_number() OVER (PARTITION BY k, feature_id ORDER BY value, subject) AS rn, count(*) OVER (PARTITION BY k, feature_id) AS n FROM outside)) GROUP BY k, feature_id"""),
)


@query("fold_purity", f"SELECT fold, feature_id, {r('score')} FROM fold_pure", *PURE_CTES)
def fold_purity(spark, d):
    return long_ids(rounded(sw.fold_purity(ad.design(spark, d), folds(spark, d)), "score"), "feature_id")


@query(
    "fold_selection",
    "SELECT fold, feature_id FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY off DESC, feature_id) AS place FROM (SELECT fold, feature_id, abs(score - median(score) OVER (PARTITION BY fold)) AS off FROM fold_pure)) WHERE off >= 0.06 OR place = 1",
    *PURE_CTES,
)
def fold_selection(spark, d):
    """Features chosen anew outside each fold."""
    return long_ids(sw.fold_selection(sw.fold_purity(ad.design(spark, d), folds(spark, d)), 0.06), "feature_id")


@query("grid_search")
def grid_search(spark, d):
    """The best setting of each linear classifier, on the features that are pure outside each fold."""
    return rounded(sw.grid_search(ad.vectors(spark, d), ad.design(spark, d), stored(spark, lambda: folds(spark, d)), GRID, 0.06), "mean")


FOLD_GM_CTES = (
    *PURE_CTES[:2],
    ("fg_grid", "SELECT feature_id, k, lo - (hi - lo) / 2 AS x0, 2 * (hi - lo) / 49 AS dx FROM (SELECT feature_id, k, min(value) AS lo, max(value) AS hi FROM outside GROUP BY feature_id, k) WHERE hi > lo"),
    ("fg_width", "SELECT feature_id, k, label, greatest(var_pop(value), 1e-12) * pow(CAST(count(*) AS DOUBLE), -0.2::DOUBLE) AS h, count(*) AS n FROM outside GROUP BY feature_id, k, label"),
    ("fg_p", """SELECT feature_id, k, label, point, max(dx) AS dx, sum(exp(-0.5 * pow((x0 + point * dx - value) / h, 2))) / (max(h) * max(n) * sqrt(2 * pi())) AS p
      FROM outside JOIN fg_width USING (feature_id, k, label) JOIN fg_grid USING (feature_id, k), range(50) g(point) GROUP BY feature_id, k, label, point"""),
    ("fg_both", "SELECT feature_id, k, point, max(dx) AS dx, coalesce(sum(p) FILTER (label = 1), 0) AS p1, coalesce(sum(p) FILTER (label <> 1), 0) AS p0 FROM fg_p GROUP BY feature_id, k, point"),
    ("fg_gap", "SELECT feature_id, k, sum(dx * abs(p1 - p0)) FILTER (point > 0) AS gap FROM fg_both GROUP BY feature_id, k"),
    ("fg_score", """SELECT thres, fold, subject, max(d.label) AS label, coalesce(sum(ln((p1 + 1e-9) / (p0 + 1e-9))) FILTER (gap > thres), 0) AS score
      FROM design d JOIN fold_t f USING (subject) JOIN fg_grid g ON g.feature_id = d.feature_id AND g.k = fold
      JOIN fg_both b ON b.feature_id = d.feature_id AND b.k = fold AND b.point = greatest(least(CAST(ceil((value - x0) / g.dx) AS BIGINT) - 1, 49), 0)
      JOIN fg_gap w ON w.feature_id = d.feature_id AND w.k = fold, (VALUES (0.1::DOUBLE), (0.2::DOUBLE)) AS t(thres) GROUP BY thres, fold, subject"""),
    ("fg_auc", """SELECT 'generative' AS model, CASE WHEN thres < 0.15 THEN 'thres=0.1' ELSE 'thres=0.2' END AS params, CAST(fold AS BIGINT) AS fold, sum(CASE WHEN label <> 1 THEN tp END) / max(n_pos * n_neg) AS score FROM (
      SELECT *, sum(CAST(label = 1 AS INT)) OVER (PARTITION BY thres, fold ORDER BY score DESC, subject DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
      count(*) FILTER (label = 1) OVER (PARTITION BY thres, fold) AS n_pos, count(*) FILTER (label <> 1) OVER (PARTITION BY thres, fold) AS n_neg FROM fg_score) GROUP BY thres, fold"""),
)


def generative_outside(spark, d) -> DataFrame:
    outs = folds(spark, d).select("subject", F.col("fold").cast("long").alias("out"))
    return sw.generative_scores(ad.design(spark, d), stored(spark, lambda: outs), "thres", [0.1, 0.2], 50).withColumnRenamed("out", "fold")


def generative_results(spark, d) -> DataFrame:
    """(model, params, fold, score): area of the generative model's settings in each fold."""
    return rf.fold_scores(generative_outside(spark, d))


@query("generative_in_folds", f"SELECT thres, CAST(fold AS BIGINT) AS fold, subject, label, {r('score')} FROM fg_score", *FOLD_GM_CTES)
def generative_in_folds(spark, d):
    """Every row scored by the generative model of all rows outside its fold, with two thresholds."""
    told = generative_outside(spark, d)
    return rounded(told.select(F.substring_index("params", "=", -1).cast("double").alias("thres"), "fold", "subject", "label", "score"), "score")


@query("generative_cross_evaluate", f"SELECT model, params, fold, {r('score')} FROM fg_auc", *FOLD_GM_CTES)
def generative_cross_evaluate(spark, d):
    return rounded(generative_results(spark, d), "score")


@query(
    "best_parameter",
    "SELECT model, params, round(mean, 6) + 0.0 AS mean FROM (SELECT model, params, avg(score) AS mean FROM fg_auc GROUP BY model, params) QUALIFY row_number() OVER (PARTITION BY model ORDER BY round(mean, 9) DESC, params) = 1",
    *FOLD_GM_CTES,
)
def best_parameter(spark, d):
    return rounded(ev.best_parameter(generative_results(spark, d)), "mean")


@query("loso_score")
def loso_score(spark, d):
    """Area of every linear classifier over rows scored by fits on all others."""
    return rounded(ev.auc(rf.leave_one_out(ad.vectors(spark, d), GRID), ["model", "params"]), "auc")


@query("pair_refits")
def pair_refits(spark, d):
    """Two rows left out, 50 times, for every setting of the seven families."""
    told = sw.pair_predictions(cohort(spark, d), stored(spark, lambda: ev.opposite_pairs(ids(spark, d), 50)), FAMILIES)
    return rounded(ev.pair_results(told, ["model", "params"]), "accuracy", "ties")


@query("model_sweep")
def model_sweep(spark, d):
    path, of = scratch(spark), stored(spark, lambda: folds(spark, d))
    pairs = stored(spark, lambda: ev.opposite_pairs(ids(spark, d), 50))
    tables.write_results(sw.model_sweep(cohort(spark, d), of, pairs, FAMILIES, keep=0.4), path)
    return rounded(spark.read.parquet(path), "auc", "accuracy", "ties", "score")


@query("write_results", "SELECT model, params, round(avg(score), 6) + 0.0 AS mean FROM fg_auc GROUP BY model, params", *FOLD_GM_CTES)
def write_results(spark, d):
    """Areas by fold of the generative model's settings, stored and read again."""
    path = scratch(spark)
    tables.write_results(generative_results(spark, d), path)
    return rounded(spark.read.parquet(path).groupBy("model", "params").agg(F.avg("score").alias("mean")), "mean")


def inverse(v):
    return 1 / (0.1 + v)


def densities(spark, d) -> DataFrame:
    """(subject, feature_id, density, label)."""
    return stored(spark, lambda: density.density_at_points(ad.design(spark, d))).join(ids(spark, d), "subject")


REST = "sum(n1) OVER f - n1 AS n1, sum(n0) OVER f - n0 AS n0, sum(s1) OVER f - s1 AS s1, sum(s0) OVER f - s0 AS s0"
DETECT_CTES = (
    ("dens", KDE), ("fold_t", FOLD_SQL),
    ("d_gap", f"""SELECT feature_id, fold, round(abs(s1 / n1 - s0 / n0) / nullif(sqrt(q / (n1 + n0) - pow((s1 + s0) / (n1 + n0), 2)), 0), 9) AS gap FROM (SELECT feature_id, fold, {REST}, sum(q) OVER f - q AS q FROM (
      SELECT feature_id, fold, count(*) FILTER (d.label = 1) AS n1, count(*) FILTER (d.label <> 1) AS n0, coalesce(sum(value) FILTER (d.label = 1), 0) AS s1, coalesce(sum(value) FILTER (d.label <> 1), 0) AS s0, sum(value * value) AS q
      FROM design d JOIN fold_t USING (subject) GROUP BY feature_id, fold) WINDOW f AS (PARTITION BY feature_id))"""),
    ("d_chosen", "SELECT fold, feature_id FROM d_gap QUALIFY row_number() OVER (PARTITION BY fold ORDER BY gap DESC, feature_id) <= 16"),
    ("d_weight", f"""SELECT feature_id, fold, ln(s1 / n1) - ln(s0 / n0) AS weight FROM (SELECT feature_id, fold, {REST} FROM (
      SELECT feature_id, fold, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label <> 1) AS n0, coalesce(sum(1 / (0.1::DOUBLE + density)) FILTER (label = 1), 0) AS s1, coalesce(sum(1 / (0.1::DOUBLE + density)) FILTER (label <> 1), 0) AS s0
      FROM dens JOIN fold_t USING (subject) GROUP BY feature_id, fold) WINDOW f AS (PARTITION BY feature_id)) JOIN d_chosen USING (fold, feature_id)"""),
    ("d_score", "SELECT fold, subject, max(label) AS label, avg(weight / (0.1::DOUBLE + density)) AS score FROM dens JOIN fold_t USING (subject) JOIN d_weight USING (fold, feature_id) GROUP BY fold, subject"),
)


@query(
    "detection_cross_evaluate",
    """SELECT fold, round(sum(CASE WHEN label <> 1 THEN tp END) / max(n_pos * n_neg), 6) + 0.0 AS auc FROM (SELECT *, sum(CAST(label = 1 AS INT)) OVER (PARTITION BY fold ORDER BY score DESC, subject DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
    count(*) FILTER (label = 1) OVER (PARTITION BY fold) AS n_pos, count(*) FILTER (label <> 1) OVER (PARTITION BY fold) AS n_neg FROM d_score) GROUP BY fold""",
    *DETECT_CTES,
)
def detection_cross_evaluate(spark, d):
    """Selection on values outside each fold, weights from densities there, scores inside."""
    of = folds(spark, d).select("subject", "fold")
    chosen = rf.gap_features(ad.design(spark, d).join(of, "subject"), 16)
    scored = rf.detect_in_folds(densities(spark, d).join(of, "subject"), chosen, inverse, inverse)
    return rounded(ev.auc(scored, ["fold"]), "auc")


@query(
    "detection_pair_score",
    """SELECT round(count(*) FILTER (a > b) / CAST(count(*) FILTER (a <> b) AS DOUBLE), 6) + 0.0 AS accuracy, round(count(*) FILTER (a = b) / CAST(count(*) AS DOUBLE), 6) + 0.0 AS ties FROM (
    SELECT pos, neg, avg(w / (0.1::DOUBLE + x)) AS a, avg(w / (0.1::DOUBLE + y)) AS b FROM (SELECT pos, neg, p.density AS x, q.density AS y,
      ln((s1 - 1 / (0.1::DOUBLE + p.density)) / (n1 - 1)) - ln((s0 - 1 / (0.1::DOUBLE + q.density)) / (n0 - 1)) AS w
      FROM opposite JOIN dens p ON p.subject = pos JOIN dens q ON q.subject = neg AND q.feature_id = p.feature_id JOIN d_sums s ON s.feature_id = p.feature_id) GROUP BY pos, neg)""",
    ("dens", KDE), *pair_ctes("ids", 200),
    ("d_sums", "SELECT feature_id, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label <> 1) AS n0, sum(1 / (0.1::DOUBLE + density)) FILTER (label = 1) AS s1, sum(1 / (0.1::DOUBLE + density)) FILTER (label <> 1) AS s0 FROM dens JOIN ids USING (subject) GROUP BY feature_id"),
)
def detection_pair_score(spark, d):
    """Weights from the densities of all but the two rows that are scored."""
    told = rf.detect_pairs(densities(spark, d), ev.opposite_pairs(ids(spark, d), 200), inverse, inverse)
    return rounded(ev.pair_results(told), "accuracy", "ties")
