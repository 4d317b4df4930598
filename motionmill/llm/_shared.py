"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

#: Texts that reach a Python worker at once; long texts make larger batches, so few rows are taken.
ROWS_PER_BATCH = 256
Kept = TypeVar("Kept")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One of our own is set only where none is named, and only in one machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(named)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, without the lineage behind it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows that one Arrow batch holds, so that whole long texts fit a worker.

    The setting is read when a query is planned, so it stays lowered in the session that runs these operators.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))


_KEPT: dict[str, object] = {}


def kept(key: str, build: Callable[[], Kept]) -> Kept:
    """What ``build`` makes, kept in this Python worker until another key is asked for.

    Workers outlive the stages that they serve; with one place for all operators, a worker never holds the models and
    stores of two.
    """
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = build()
    return _KEPT[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
