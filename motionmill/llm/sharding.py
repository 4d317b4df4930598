"""Shards by fixed virtual slots.

Each row hashes to one of ``N_SLOTS`` virtual slots by its key, and a small versioned map says which shard owns a
slot. Rows never move on their own: growing or rebalancing edits the map. Two edits are offered: ``grow_map`` adds a
shard that takes slots from all others and moves none between them, ``rebalance_map`` moves the fewest slots that
level the bytes. ``save_map`` adds a version to those stored at a path, ``load_map`` reads the last or an earlier one.

Nulls: a null key hashes like any other value, a null text has size 1 (no bytes plus one). Empty tables give empty
results. Other columns of the input are not touched or read, so their names cannot clash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

N_SLOTS = 4096
#: A slot's rows are numbered in this many parts, so that one slot with many keys is not one task.
PARTS = 16


def slot_of(key: Column, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_slots)).cast("int")


def _owner(slot: Column, n_shards: int) -> Column:
    """The last shard, in the order they were added, that draws the slot: shard j draws one slot in j + 1."""
    draws = F.filter(F.sequence(F.lit(1), F.lit(n_shards)), lambda j: F.pmod(F.xxhash64(slot, j), j) == 0)
    return (F.array_max(draws) - 1).cast("int")


def initial_map(spark: SparkSession, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Columns version, vslot, shard; a function of the slot and the number of shards alone."""
    slots = spark.range(n_slots).select(F.col("id").cast("int").alias("vslot"))
    return slots.select(F.lit(1).alias("version"), "vslot", _owner(F.col("vslot"), n_shards).alias("shard"))


def grow_map(slot_map: DataFrame, n_shards: int) -> DataFrame:
    """The next version, for one shard more than ``n_shards``: some slots go to the new shard, all others stay."""
    new = F.pmod(F.xxhash64("vslot", F.lit(n_shards + 1)), F.lit(n_shards + 1)) == 0
    return slot_map.select(
        (F.col("version") + 1).alias("version"), "vslot", F.when(new, F.lit(n_shards)).otherwise(F.col("shard")).alias("shard")
    )


def save_map(slot_map: DataFrame, path: str) -> None:
    """Stores the version of ``slot_map`` beside those at ``path``; a version that is there already is an error."""
    version = slot_map.agg(F.max("version")).first()[0]
    slot_map.drop("version").write.parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The map at ``path``, of the last version or the one asked for."""
    every = spark.read.parquet(path)
    at = every.agg(F.max("version")).first()[0] if version is None else version
    return every.where(F.col("version") == at).select("version", "vslot", "shard")


def slot_sizes(rows: DataFrame, size: str = "size") -> DataFrame:
    """Rows and bytes of each virtual slot: columns vslot, n_rows, n_bytes."""
    return rows.groupBy("vslot").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(size).alias("n_bytes"))


def rebalance_map(slot_map: DataFrame, sizes: DataFrame, n_shards: int) -> DataFrame:
    """The next version, with bytes levelled: shards above the mean give up slots, shards below it take them.

    A shard keeps slots, in slot order, up to the mean; what is left over is laid end to end and handed to the
    shards with room, laid end to end as well. All tables here have at most ``N_SLOTS`` rows.
    """
    known = slot_map.join(sizes.select("vslot", "n_bytes"), "vslot", "left").fillna(0, ["n_bytes"])
    mean = F.sum("n_bytes").over(W.partitionBy()) / n_shards
    upto = F.sum("n_bytes").over(W.partitionBy("shard").orderBy("vslot"))
    known = known.withColumns({"mean": mean, "upto": upto})
    stays = (F.col("upto") <= F.col("mean")) | (F.col("n_bytes") == 0)
    loose = known.where(~stays).withColumn(
        "middle", F.sum("n_bytes").over(W.partitionBy().orderBy(F.desc("n_bytes"), "vslot")) - F.col("n_bytes") / 2
    )
    shards = slot_map.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("to_shard"))
    filled = known.where(stays).groupBy("shard").agg(F.sum("n_bytes").alias("kept"))
    room = shards.join(filled, F.col("to_shard") == F.col("shard"), "left").crossJoin(
        known.agg(F.coalesce(F.sum("n_bytes") / n_shards, F.lit(0.0)).alias("goal"))
    ).select("to_shard", F.greatest(F.col("goal") - F.coalesce("kept", F.lit(0)), F.lit(0.0)).alias("room"))
    ends = room.withColumn("hi", F.sum("room").over(W.partitionBy().orderBy("to_shard"))).withColumn("lo", F.col("hi") - F.col("room"))
    moved = loose.join(
        F.broadcast(ends), (F.col("middle") >= F.col("lo")) & (F.col("middle") < F.col("hi")), "left"
    ).select("vslot", F.col("to_shard"))
    return slot_map.join(moved, "vslot", "left").select(
        (F.col("version") + 1).alias("version"), "vslot", F.coalesce("to_shard", "shard").alias("shard")
    )


def sized_rows(df: DataFrame, key: str = "doc_id", text: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """Key, size (bytes of UTF-8 plus one), crc32 of the text and virtual slot; texts themselves stay behind."""
    body = F.coalesce(F.col(text), F.lit(""))
    return df.select(
        F.col(key),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        slot_of(F.col(key), n_slots).alias("vslot"),
    )


def place(rows: DataFrame, slot_map: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds shard and ``slot``, the row's gapless place within its shard, from 0.

    Equal rows are counted before the exchange and dealt out again after it, so a row that repeats is one row in
    between. Places are counted in two steps, so that no task sees a whole shard: rows are numbered within parts of a
    virtual slot, and the parts' counts, at most ``N_SLOTS * PARTS`` rows and so small enough to broadcast, give each
    part's first place.
    """
    part = F.pmod(F.xxhash64(key, "text_crc32", "size"), F.lit(PARTS)).cast("int")
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies")).withColumn("part", part)
    counts = counted.groupBy("vslot", "part").agg(F.sum("copies").alias("n")).join(F.broadcast(slot_map.select("vslot", "shard")), "vslot")
    before = F.sum("n").over(W.partitionBy("shard").orderBy("vslot", "part")) - F.col("n")
    starts = counts.select("vslot", "part", "shard", before.alias("first"))
    order = W.partitionBy("vslot", "part").orderBy(key, "text_crc32", "size").rowsBetween(W.unboundedPreceding, 0)
    numbered = counted.withColumn("inner", F.sum("copies").over(order) - F.col("copies")).join(F.broadcast(starts), ["vslot", "part"])
    first = F.col("first") + F.col("inner")
    return numbered.select(*rows.columns, "shard", F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("slot"))


def op10_slots(spark: SparkSession, sf_dir: str, map_path: str | None = None) -> DataFrame:
    """Places by the first version of the map at ``map_path``; owners by the second, grown by a shard, and by the third, that with the bytes of all documents levelled."""
    from motionmill.llm._shared import shared_dir, table, written

    n, path = 16, map_path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    rows = sized_rows(table(spark, sf_dir, "documents"))
    save_map(initial_map(spark, n), path)
    save_map(grow_map(load_map(spark, path), n), path)
    save_map(rebalance_map(load_map(spark, path), written(slot_sizes(rows), "slot-sizes"), n + 1), path)
    owner = lambda version, name: load_map(spark, path, version).select("vslot", F.col("shard").alias(name))
    later = owner(2, "grown_shard").join(owner(3, "level_shard"), "vslot")
    return place(rows, load_map(spark, path, 1)).join(F.broadcast(later), "vslot").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "level_shard"
    )
