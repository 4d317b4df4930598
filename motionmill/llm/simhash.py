"""SimHash near-duplicates: fingerprints, pigeonhole blocks, exact Hamming distance, components.

A text is lower-cased in A-Z, cut into words at ASCII white space and into shingles of ``width`` words, repeats
included; a shorter text is one shingle, a text without words has fingerprint 0. Bit i of the fingerprint is 1 where
over half of the shingles' XXH64 (UTF-8, seed 42) have it.

All further work is on distinct fingerprints, so copies are never paired. A fingerprint is cut into ``N_BLOCKS`` blocks;
two fingerprints within ``MAX_BITS`` bits share all but ``MAX_BITS`` blocks, so they meet under one of the keys made
of the other blocks. Buckets of at most ``BUCKET`` fingerprints are joined with themselves and each pair is verified.
Larger buckets would pair quadratically: their fingerprints are linked through their one-bit neighbours instead. Two
fingerprints are within two bits if and only if they share one of the 65 values that are at most one bit away, and
at most 65 fingerprints can share such a value, so this is as exact, and linear.

Null texts count as empty. Rows with a null id get their fingerprint's component, null where it has no id at all.
Only the id and text columns are read.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from motionmill.llm._shared import cut, small_batches, table, written
from motionmill.llm.components import components

WIDTH = 3
MAX_BITS = 2
N_BLOCKS = 4
BUCKET = 64
_hash = partial(xxhash.xxh64_intdigest, seed=42)
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, width: int = WIDTH) -> list[int]:
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return []
    if len(words) < width:
        return [_hash(b" ".join(words))]
    return [_hash(b" ".join(s)) for s in zip(*(words[i:] for i in range(width)))]


def majority(hashes: list[list[int]]) -> np.ndarray:
    """A fingerprint for each list, as signed 64-bit numbers.

    Eight bits are counted at once in the bytes of a 64-bit sum over at most 255 hashes; the sums are then added up.
    """
    sizes = np.array([len(x) for x in hashes], dtype=np.int64)
    out = np.zeros(len(hashes), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if not full.size:
        return out.view(np.int64)
    flat = np.fromiter((h for x in hashes for h in x), dtype=np.uint64, count=int(sizes.sum()))
    first = np.cumsum(sizes[full]) - sizes[full]
    pieces = (sizes[full] + 254) // 255
    of_piece = np.cumsum(pieces) - pieces
    starts = np.repeat(first - 255 * of_piece, pieces) + 255 * np.arange(pieces.sum())
    counts = np.empty((full.size, 64), dtype=np.int64)
    for k in range(8):
        lanes = np.add.reduceat((flat >> np.uint64(k)) & _LANES, starts).view(np.uint8).reshape(-1, 8)
        counts[:, k::8] = np.add.reduceat(lanes.astype(np.int64), of_piece, axis=0)
    bits = (2 * counts > sizes[full, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out.view(np.int64)


@F.pandas_udf(T.LongType())
def _fingerprint(texts: pd.Series, width: pd.Series) -> pd.Series:
    w = int(width.iloc[0]) if len(width) else WIDTH
    return pd.Series(majority([shingle_hashes(t, w) for t in texts]))


def fingerprints(df: DataFrame, text: str = "text", width: int = WIDTH) -> Column:
    small_batches(df.sparkSession)
    return _fingerprint(F.col(text), F.lit(width))


def _block_keys(fp: Column, n_blocks: int, max_bits: int) -> Column:
    """Array of (part, key): for each choice of blocks left out, the bits of all others."""
    edges = [round(64 * i / n_blocks) for i in range(n_blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    keys = []
    for part, out in enumerate(combinations(range(n_blocks), max_bits)):
        mask = sum(m for i, m in enumerate(masks) if i not in out)
        keys.append(F.struct(F.lit(part).alias("part"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("key")))
    return F.array(*keys)


def fingerprint_links(distinct: DataFrame, n_blocks: int = N_BLOCKS, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between the ids of fingerprints at most ``max_bits`` apart; ``distinct``: fp, id, one row per fp.

    In large buckets the links are those to the least id around a one-bit neighbour, enough for components.
    """
    if max_bits != 2:
        raise ValueError("the way for large buckets holds for two bits")
    keys = distinct.select("fp", "id", F.inline(_block_keys(F.col("fp"), n_blocks, max_bits)))
    sizes = cut(keys.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    paired = keys.join(sizes.where(F.col("n") <= bucket), ["part", "key"], "left_semi")
    other = paired.select("part", "key", F.col("fp").alias("fp2"), F.col("id").alias("b"))
    near = (
        paired.join(other, ["part", "key"])
        .where((F.col("id") < F.col("b")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= max_bits))
        .select(F.col("id").alias("a"), "b")
    )
    dense = keys.join(sizes.where(F.col("n") > bucket), ["part", "key"], "left_semi").select("fp", "id").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64) * (i == 63))) for i in range(64)])
    around = dense.select("id", F.explode(flips).alias("value")).groupBy("value").agg(F.collect_set("id").alias("ids")).where(F.size("ids") > 1)
    star = around.select(F.array_min("ids").alias("a"), F.explode("ids").alias("b")).where("a <> b")
    return near.unionByName(star).distinct()


def _classes(prints: DataFrame) -> DataFrame:
    """(fp, component_id) of every fingerprint of ``prints`` (doc_id, fp)."""
    ids = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("id")))
    roots = components(fingerprint_links(ids.where("id is not null")))
    return ids.join(roots.withColumnRenamed("node", "id"), "id", "left").select("fp", F.coalesce("root", "id").alias("component_id"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, fp, component_id), one row per row of ``df``."""
    prints = cut(df.select(F.col(doc_id).alias("doc_id"), fingerprints(df, text, width).alias("fp")))
    return prints.join(_classes(prints), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row of each component, that of its least id; of rows without any id, one per fingerprint.

    Only ids and fingerprints take part in the choice. Of rows that repeat the chosen id and fingerprint, the one with
    the least hash of its text stays, then of all its columns but maps.

    Texts are fingerprinted once, into a table where each row has a number; the choice is made on small columns, and
    texts are exchanged once, unsorted, to meet the numbers chosen.
    """
    of_row = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map" not in f.dataType.simpleString()])
    columns = [F.struct("*").alias("row"), F.col(doc_id).alias("doc_id"), fingerprints(df, text, width).alias("fp"), F.xxhash64(text).alias("of_text"), of_row.alias("of_row")]
    named = written(df.select(*columns).withColumn("number", F.monotonically_increasing_id()), "fingerprints")
    prints = named.drop("row")
    found = prints.join(_classes(prints), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    alone = F.when(F.col("component_id").isNull(), F.col("fp"))
    chosen = found.groupBy("component_id", alone.alias("alone")).agg(F.min(F.struct("fp", "of_text", "of_row", "number")).alias("c")).select("c.number")
    return named.join(chosen.hint("shuffle_hash"), "number", "left_semi").select("row.*")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
