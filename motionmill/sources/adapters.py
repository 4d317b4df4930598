"""The given tables in the shapes that the operators take. One frame is four hours, four blocks of days are the stimuli."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

FPS = 1.0
CHANNELS = ["c1", "c2"]
STIMULI = {1: 48.0, 2: 48.0, 4: 48.0, 6: 36.0}
EVENTS = [(1, "e1", 0, 12), (2, "e2", 6, 18), (2, "e3", 12, 24), (4, "e4", 8, 20), (4, "e5", 16, 30), (6, "e6", 0, 36)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / 3.6e9
    block = F.floor(F.col("h") / 192)
    return (
        _table(spark, sf_dir, "events")
        .withColumn("h", hours)
        .select(
            F.col("user_id").alias("subject"),
            F.when(block == 0, 1).when(block == 1, 2).when(block == 2, 4).otherwise(6).alias("stimulus"),
            F.col("event_id").alias("sample_idx"),
            ((F.col("h") - 192 * block) / 4.0).alias("t"),
            F.when(F.col("event_type") == "error", 0).otherwise(1).alias("detected"),
            F.col("value").alias("c1"),
            F.get_json_object("props", "$.k").cast("double").alias("c2"),
        )
    )


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user, with the raw label and 20 pass or fail answers, both functions of the id."""
    ids = _table(spark, sf_dir, "events").select(F.col("user_id").alias("subject")).distinct()
    s = F.col("subject")
    raw = F.when(s % 10 == 0, "suspected").when(s % 10 == 9, "unknown").when(s % 2 == 0, "yes").otherwise("no")
    answers = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.when((s * 31 + i * 7) % 5 == 0, "fail").otherwise("pass"))
    return ids.select("subject", raw.alias("raw_label"), answers.alias("answers"))


def design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, feature_id, value, label): embeddings in long form."""
    return _table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("subject"), F.posexplode("embedding").alias("feature_id", "value"), F.when(F.col("label") < 5, 1).otherwise(-1).alias("label")
    ).select("subject", "feature_id", F.col("value").cast("double").alias("value"), "label")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, vector, label): embeddings as arrays."""
    return _table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("subject"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), F.when(F.col("label") < 5, 1).otherwise(-1).alias("label")
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return _table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        F.col("doc_id").alias("subject"), F.col("n_chars").cast("double").alias("score"), F.when(F.col("quality") == 1, 1).otherwise(-1).alias("label")
    )


def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, sample_idx, landmarks): 98 values with a geometry that is never degenerate."""
    value = lambda k: ((k % 49) * 37 % 49) * F.when(k < 49, 1.0).otherwise(0.7) + 10 * F.get("embedding", k % 64).cast("double")
    return _table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_idx"), F.col("label").alias("subject"), F.transform(F.sequence(F.lit(0), F.lit(97)), value).alias("landmarks")
    )
