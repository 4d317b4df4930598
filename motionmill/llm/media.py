"""Media columns of progressive JPEG.

``decode_media`` turns a column of files into full-resolution RGB tensors; ``store_payload`` keeps bytes losslessly in
such files. A payload's unit is the coefficient: 64 bytes are one 8x8 block in zigzag order, six blocks one unit of a
4:2:0 image, units run row by row over at most ``UNITS_A_ROW``; with unit quantisation they come back exactly. The
payload's length stands in the file's comment.

Null texts are empty; an empty text is one block of zeros. A file that is null or no progressive JPEG gives nulls. Ids
and other columns stay as they are. Long texts are handled a few at a time, ``BYTES_AT_ONCE`` of payload together.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from motionmill.llm import jpeg
from motionmill.llm._shared import small_batches, table

UNITS_A_ROW = 64
#: Rows of units that the format's 16-bit height has room for; longer texts (over 100 MB) make wider rows.
MOST_ROWS = 65_535 // 16
BYTES_AT_ONCE = 1 << 21
TENSOR = T.StructType([T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("rgb", T.BinaryType())])
DIGEST = T.StructType(
    [T.StructField(k, T.LongType()) for k in ("n_bytes", "payload_bytes")] + [T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType())]
    + [T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())]
)


def pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 64 if raw else 64)


def shape(blocks: int) -> tuple[int, int]:
    """Units per row and rows for so many blocks."""
    units = -(-blocks // 6)
    wide = max(min(units, UNITS_A_ROW), -(-units // MOST_ROWS))
    return wide, -(-units // wide)


def store(payloads: list[bytes]) -> list[bytes]:
    images = []
    for p in payloads:
        wide, high = shape(len(p) // 64)
        room = np.zeros(wide * high * 6 * 64, np.uint8)
        room[: len(p)] = np.frombuffer(p, np.uint8)
        images.append((room.reshape(-1, 64), wide, high, struct.pack(">Q", len(p))))
    return jpeg.encode(images)


def read_back(image: jpeg._Image, comps: list[np.ndarray]) -> bytes:
    """The payload of a decoded file, from its coefficients."""
    wide, high = image.wide, image.high
    blocks = np.empty((high * wide, 6, 64), np.uint8)
    luma = comps[0].reshape(high, 2, wide, 2, 64)
    blocks[:, :4] = luma.transpose(0, 2, 1, 3, 4).reshape(-1, 4, 64)
    blocks[:, 4], blocks[:, 5] = comps[1], comps[2]
    return blocks.tobytes()[: struct.unpack(">Q", image.comments[0])[0]]


def _parts(sizes: list[int]) -> Iterator[slice]:
    """Stretches of items that hold about ``BYTES_AT_ONCE`` together."""
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > BYTES_AT_ONCE:
            yield slice(begin, i)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def feature(tensor: np.ndarray) -> str:
    """Means of the three channels in thousandths and the checksum of the tensor."""
    total = tensor.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    area = tensor.shape[0] * tensor.shape[1]
    return "{}.{}.{}:{:08x}".format(*(int(t) * 1000 // area for t in total), zlib.crc32(tensor.tobytes()))


def payload_digests(texts: list[str | None]) -> list[tuple]:
    """Rows of ``DIGEST``: each text stored, read from its file, and what the file shows."""
    raw = [(t or "").encode() for t in texts]
    rows = []
    for part in _parts([len(r) for r in raw]):
        files = store([pad(r) for r in raw[part]])
        for r, f, (image, comps) in zip(raw[part], files, jpeg.coefficients(files)):
            got = read_back(image, comps)
            rows.append((len(r), len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-64:]), len(f), hashlib.sha256(f).hexdigest(), feature(jpeg.rgb(image, comps))))
    return rows


def store_payload(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``media``, the file that holds the text's padded bytes; a column of that name is replaced."""
    small_batches(df.sparkSession)

    @F.pandas_udf(T.BinaryType())
    def media(texts: pd.Series) -> pd.Series:
        raw = [(t or "").encode() for t in texts]
        return pd.Series([f for part in _parts([len(r) for r in raw]) for f in store([pad(r) for r in raw[part]])], dtype=object)

    return df.withColumn("media", media(F.col(text)))


def decode_media(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds ``tensor``: height, width and the RGB bytes of each file; a column of that name is replaced."""
    small_batches(df.sparkSession)

    @F.pandas_udf(TENSOR)
    def tensor(files: pd.Series) -> pd.DataFrame:
        rows = []
        for f in files:
            try:
                out = jpeg.rgb(*jpeg.coefficients([bytes(f)])[0]) if f is not None else None
            except (ValueError, IndexError, KeyError, AttributeError, struct.error):
                out = None
            rows.append((None, None, None) if out is None else (out.shape[0], out.shape[1], out.tobytes()))
        return pd.DataFrame(rows, columns=["height", "width", "rgb"]).astype({"height": "Int32", "width": "Int32"})

    return df.withColumn("tensor", tensor(F.col(media)))


def op3_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)

    @F.pandas_udf(DIGEST)
    def digest(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(payload_digests(texts.tolist()), columns=DIGEST.names)

    return table(spark, sf_dir, "documents").select("doc_id", digest("text").alias("d")).select("doc_id", "d.*")
