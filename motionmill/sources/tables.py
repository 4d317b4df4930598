"""Reading recordings and subjects, storing layers, splits and results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

SAMPLES = T.StructType(
    [T.StructField("subject", T.LongType()), T.StructField("stimulus", T.IntegerType()), T.StructField("sample_idx", T.LongType()),
     T.StructField("t", T.FloatType()), T.StructField("detected", T.IntegerType()), T.StructField("landmarks", T.ArrayType(T.FloatType()))]
)
SUBJECTS = T.StructType(
    [T.StructField("subject", T.LongType()), T.StructField("answers", T.ArrayType(T.StringType())), T.StructField("raw_label", T.StringType()),
     T.StructField("scoring", T.ArrayType(T.DoubleType()))]
)


def read_samples(spark: SparkSession, path: str, schema: T.StructType = SAMPLES) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_subjects(spark: SparkSession, path: str, schema: T.StructType = SUBJECTS) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def encode_label(raw: Column) -> Column:
    """yes 1, no -1, suspected 0, anything else null."""
    return F.when(raw == "yes", 1).when(raw == "no", -1).when(raw == "suspected", 0)


def binarize_answers(answers: Column) -> Column:
    return F.transform(answers, lambda x: (x == "fail").cast("int"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table stands at ``path``, asked of the file system that the path names."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored layer at ``path``, built and written first if it isn't there."""
    if not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def build_all(spark: SparkSession, root: str, layers: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
    return {name: materialize(spark, f"{root}/{name}", build) for name, build in layers.items()}


def write_split(train: DataFrame, test: DataFrame, root: str) -> None:
    for name, part in (("train", train), ("test", test)):
        part.select(F.col("subject").alias("Id"), F.col("label").alias("Output")).write.mode("overwrite").option("header", True).csv(f"{root}/{name}")


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").parquet(path)
