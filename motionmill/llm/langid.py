"""Language by compression: a zstandard raw-content dictionary per language, and the one that makes a text smallest.

Texts are brought to one form: composed, lower case, letters only, single blanks. A language's dictionary holds words of
a bounded sample, ``SAMPLE`` texts of it, the least by a hash of the id, rare words first, since what stands near the
end of a dictionary is the cheapest to refer to. A word goes to the languages that have at least half of its share
summed over all, so passages in another language don't get into a dictionary. Counting is done in Spark; at most
``WORDS`` words a language, ``MAX_LANGUAGES`` languages, reach the driver.

A whole text is cut into pieces of ``PIECE`` bytes. Each is compressed with every dictionary, so the text's own history
never outweighs the dictionary, and the sizes are summed. The least wins; of equal sizes the language with more texts to
learn from, then the first by name. ``score`` is the winner's share of exp(-``SHARPNESS`` size / least size);
``rejected`` tells that the margin to the second is below ``MARGIN`` of its size, or that there is no letter.

Null texts and texts without a letter get ``und``, score 0 and rejected; so does every text where there is nothing to
learn from. With one language alone, it is given with score 1. Rows with a null lang, id or text don't teach; of rows
that repeat an id the least text of each lang teaches. Repeated rows are answered alike. Other columns are kept.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from motionmill.llm._shared import kept, small_batches, table

SAMPLE = 400
SPARE = 4.0
DICTIONARY = 1 << 15
WORDS = 8192
PIECE = 2048
LEVEL = 11
SHARPNESS = 50.0
MARGIN = 0.01
MAX_LANGUAGES = 200
UNKNOWN = "und"
FOLDS, HELD_OUT = 4, 2
#: A longer run of letters enters a dictionary in parts of this size.
RUN = 24
_OTHER = re.compile(r"[\W\d_]+")
ANSWER = "nearest string, score double, rejected boolean"


def letters(text: str | None) -> str:
    """The letters of a text in lower case, other signs as single blanks; empty where there is none."""
    text = text or ""
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    out = _OTHER.sub(" ", text.lower()).strip()
    return out if out.isascii() or any(map(str.isalpha, out)) else ""  # \w has signs such as superscript digits too


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def usable_rows(documents: DataFrame) -> DataFrame:
    return documents.where((fold(F.col("doc_id")) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def text_counts(documents: DataFrame) -> list[tuple[str, int]]:
    """(lang, usable rows), most rows first; at most ``MAX_LANGUAGES``."""
    counts = usable_rows(documents).groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; name fewer or raise MAX_LANGUAGES")
    return [(r["lang"], r["count"]) for r in counts]


def _by_language(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("lang")]


def training_rows(documents: DataFrame, counts: list[tuple[str, int]], sample: int = SAMPLE) -> DataFrame:
    """(doc_id, lang, text): at most ``sample`` texts of each language outside the held-out fold, the least by a hash of the id.

    Only ids whose hash lies in a language's lowest part, made for some ``SPARE`` times as many as are wanted, are ranked.
    """
    usable = usable_rows(documents)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    few = usable.where(place < _by_language({lang: SPARE * sample / n for lang, n in counts}))
    ids = few.select("lang", "doc_id", F.xxhash64("doc_id").alias("hash")).distinct()
    first = F.row_number().over(W.partitionBy("lang").orderBy(F.pmod("hash", F.lit(1 << 40)), "doc_id"))
    picked = ids.withColumn("place", first).where(F.col("place") <= sample).select("lang", "doc_id")
    return usable.select("lang", "doc_id", "text").join(F.broadcast(picked), ["lang", "doc_id"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            words = {w[i : i + RUN] for w in letters(text).split() for i in range(0, len(w), RUN)}
            yield pd.DataFrame({"lang": lang, "word": sorted(words)}).astype("object")


class Model:
    """Dictionaries by language, the language with most texts first."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages = list(dictionaries)
        self.compress = []
        for raw in dictionaries.values():
            how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=PIECE, dict_size=len(raw), write_content_size=False)
            content = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=how)
            self.compress.append(zstandard.ZstdCompressor(compression_params=how, dict_data=content).compress)

    def sizes(self, text: str | None) -> list[int]:
        """Bytes of the whole text with each language's dictionary; empty where it has no letter."""
        raw = letters(text).encode()
        pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
        return [sum(map(len, map(compress, pieces))) for compress in self.compress] if raw else []

    def answer(self, text: str | None) -> tuple[str, float, bool]:
        sizes = self.sizes(text)
        if not sizes:
            return UNKNOWN, 0.0, True
        least, *others = sorted(sizes)
        share = 1 / sum(math.exp(-SHARPNESS * (s / least - 1)) for s in sizes)
        return self.languages[sizes.index(least)], share, bool(others) and others[0] - least < MARGIN * others[0]


def train(documents: DataFrame, sample: int = SAMPLE) -> dict[str, bytes]:
    """A dictionary for each language, the language with most texts first."""
    small_batches(documents.sparkSession)
    counts = text_counts(documents)
    out = {str(lang): b"" for lang, _ in counts}
    if not out:
        return out
    held = training_rows(documents, counts, sample).mapInPandas(_words, "lang string, word string").groupBy("lang", "word").agg(F.count("*").alias("n"))
    share = F.col("n") / _by_language({str(lang): float(min(n, sample)) for lang, n in counts})
    own = held.withColumn("share", share).withColumn("all", F.sum("share").over(W.partitionBy("word"))).where("share >= 0.5 * all")
    often = own.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("place") <= WORDS)
    words: dict[str, list[tuple[int, str]]] = defaultdict(list)
    for r in often.select("lang", "place", "word").collect():
        words[r["lang"]].append((-r["place"], r["word"]))
    for lang in out:  # eight blanks first: zstandard takes no content below eight bytes
        raw = " ".join(w for _, w in sorted(words[lang])).encode()
        out[lang] = b" " * 8 + raw[-DICTIONARY:] + b" "
    return out


def identify(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> Column:
    """A struct for each whole text: nearest (the smallest language or ``und``), score, rejected."""
    small_batches(df.sparkSession)
    sent, token = df.sparkSession.sparkContext.broadcast(dictionaries), uuid.uuid4().hex

    @F.pandas_udf(ANSWER)
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = kept(f"languages {token}", lambda: Model(sent.value))
        for texts in batches:
            rows = [model.answer(t) for t in texts]
            yield pd.DataFrame(rows, columns=["nearest", "score", "rejected"])

    return answers(F.col(text))


def keep_languages(df: DataFrame, dictionaries: dict[str, bytes], wanted: list[str], text: str = "text") -> DataFrame:
    """``df`` without the rows that are rejected or in none of the ``wanted`` languages; columns as they were."""
    rows = df.select(F.struct("*").alias("row"), identify(df, dictionaries, text).alias("said"))
    return rows.where(~F.col("said.rejected") & F.col("said.nearest").isin(wanted)).select("row.*")


def op11_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    said = documents.select("doc_id", identify(documents, train(documents)).alias("said"))
    held_out = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return said.select("doc_id", held_out.alias("held_out"), F.col("said.nearest").alias("lang_pred"), "said.score", "said.rejected")
