"""Benchmark passages in documents: CGK embedding, bit-sampling LSH over windows, exact edit distance.

Texts are lower-cased and cut into words. The CGK walk of a window reads one word at each step and moves on, or not,
by a random bit that depends on the step and the word; windows a few edits apart soon walk in step again, so edit
distance becomes Hamming distance of what they read. An LSH key samples ``SAMPLES`` steps of a walk; each of
``REPEATS`` walks has bits and steps of its own.

Windows are sized by the items: items are classed by length, and a class's walks take three quarters of its least
length in steps. Every word of a document begins a window in each class. An item is entered at every ``STRIDES``-th
word that leaves a window, so edits anywhere hide some of its windows only. A window whose first two sampled words fit
no item leaves its walk there.

A window that shares a key with an item is verified: with Myers' bit-vectors, the least edit distance in words between
the whole item and the stretch around the window. The item is found where it is at most ``EDITS`` of the item's words.
Its place is the first end of a stretch with the least edits found, and of the stretches that end there the shortest.

The benchmark is the stated query set. It is taken in blocks of about ``BLOCK_CHARS`` characters, one pass over the
documents each. Items of fewer than ``MIN_WORDS`` words are sought exactly: k edits leave one of k + 1 parts of an item
as it is, so every part is sought word for word and what stands around it is verified. In scripts without blanks every
character is a word. Items without any word can't be sought.
Null texts count as empty; null ids, and ids that are no numbers, are null in the result; repeated rows each get their
matches. Only the columns named are read.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from motionmill.llm._shared import kept, small_batches, table, written

EDITS = 0.2
REPEATS = 6
SAMPLES = 5
MIN_WORDS = 8
#: Least words of each class of items, and every how many words an item of the class is entered.
CLASSES, STRIDES = (MIN_WORDS, 16, 32), (1, 2, 4)
BLOCK_CHARS = 2_000_000
PIECE = 1 << 16
#: Scripts without blanks: Thai to Myanmar, Khmer, kana, Han and their extensions.
_DENSE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_HAS_DENSE = re.compile(f"[{_DENSE}]")
_SIGN_OR_WORD = re.compile(rf"(?=[{_DENSE}])\w|(?:(?![{_DENSE}])\w)+")
_WORD = re.compile(r"\w+")
_BITS = 18
MATCH = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType()),
     T.StructField("item_words", T.IntegerType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType())]
)


def words_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    return (_WORD if text.isascii() or not _HAS_DENSE.search(text) else _SIGN_OR_WORD).findall(text)


def best_match(item: list[int], text: list[int], from_start: bool = False) -> tuple[int, int]:
    """(least edits between ``item`` and a stretch of ``text``, that stretch's last place); with ``from_start``, of the stretches that begin with the text."""
    at: dict[int, int] = defaultdict(int)
    for i, w in enumerate(item):
        at[w] |= 1 << i
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    plus, minus, score, best, end = full, 0, len(item), len(item), -1
    for place, w in enumerate(text):
        eq = at.get(w, 0)
        diag = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (~(diag | plus) & full), plus & diag
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1 | from_start) & full, down << 1 & full
        plus, minus = down | (~(diag | up) & full), up & diag
        if score < best:
            best, end = score, place
    return best, end


class Index:
    """Items by the LSH keys of their walks: for each repeat and class of lengths a trie of sampled words, as sorted arrays."""

    def __init__(self, items: list[tuple[int | None, str | None]], repeats: int = REPEATS, samples: int = SAMPLES, edits: float = EDITS, seed: int = 11):
        self.items = [(k, w) for k, t in items if (w := words_of(t))]
        self.vocab = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in self.items for w in ws}))}
        self.ids = [[self.vocab[w] for w in ws] for _, ws in self.items]
        self.most = [int(edits * len(ws)) for ws in self.ids]
        self.width = len(self.vocab) + 1
        size = np.array([len(ws) for ws in self.ids], np.int64)
        self.size, self.longest, self.sets = size, int(size.max(initial=0)), [set(ws) for ws in self.ids]
        self.flat = np.array([*chain.from_iterable(self.ids), 0], np.int32)
        rng = np.random.default_rng(seed)
        self.tries = []
        for least, most, stride in zip(CLASSES, (*CLASSES[1:], math.inf), STRIDES):
            mine = np.flatnonzero((size >= least) & (size < most))
            steps = 3 * least // 4
            for _ in range(repeats):
                moves = rng.integers(0, 2, (steps, self.width), dtype=np.int32)
                first = int(rng.integers(0, 2))
                sampled = [first, *sorted(rng.choice(np.arange(first + 1, steps), min(samples, steps - 1) - 1, replace=False).tolist())]
                if mine.size:
                    self.tries.append(self._trie(moves, sampled, mine, size, stride))
        most = np.array(self.most, np.int64)
        for n in range(1, MIN_WORDS):  # k edits leave one of k + 1 parts of a short item as it is: each part is sought word for word
            for k in range(n):
                mine = np.flatnonzero((size == n) & (most == k))
                cuts = [n * i // (k + 1) for i in range(k + 2)]
                for begin, end in zip(cuts, cuts[1:]):
                    if mine.size:
                        part = np.ones((end - begin, self.width), np.int32), list(range(end - begin))
                        self.tries.append(self._trie(*part, mine, size, n, begin))

    def _trie(self, moves: np.ndarray, sampled: list[int], mine: np.ndarray, size: np.ndarray, stride: int, begin: int = 0) -> dict:
        per_item = (size[mine] - 1 - begin) // stride + 1
        item = np.repeat(mine, per_item)
        offset = (np.arange(item.size) - np.repeat(np.cumsum(per_item) - per_item, per_item)) * stride + begin
        start = (np.cumsum(size) - size)[item]
        at, end, state = start + offset, start + size[item], np.zeros(item.size, np.int64)
        tables, first = [], np.full(self.width, -1, np.int32)
        for j in range(sampled[-1] + 1):
            inside = at < end  # an entry whose item ends before its last sample has no key
            at, end, state, item, offset = at[inside], end[inside], state[inside], item[inside], offset[inside]
            word = self.flat[at]
            if j in sampled:
                keys, state = np.unique(state * self.width + word, return_inverse=True)
                if j == sampled[0]:
                    first[keys] = np.arange(keys.size)
                tables.append(keys)
            at = at + moves[j][word]
        order = np.argsort(state, kind="stable")
        hint = np.zeros(1 << _BITS, bool)  # of the second table, most of what isn't in it is told by a bit
        if len(tables) > 1:
            hint[self._hashed(tables[1])] = True
        return {
            "moves": moves, "sampled": sampled, "first": first, "tables": tables, "hint": hint, "item": item[order].astype(np.int32),
            "offset": offset[order].astype(np.int32), "ends": np.searchsorted(state[order], np.arange(len(tables[-1]) + 1)),
        }

    @staticmethod
    def _hashed(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)

    def _candidates(self, trie: dict, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, item) for the windows at ``start`` that share a key: where the item would begin. ``ids`` has zeros at its end for all steps."""
        at, state, k = start, None, 0
        for j in range(trie["sampled"][-1] + 1):
            word = ids[at]
            if j == trie["sampled"][k]:
                if k == 0:
                    state = trie["first"][word].astype(np.int64)
                    keep = np.flatnonzero(state >= 0)
                    state = state[keep]
                else:
                    keys, wanted = trie["tables"][k], state * self.width + word
                    keep = np.flatnonzero(trie["hint"][self._hashed(wanted)]) if k == 1 else np.arange(wanted.size)
                    wanted = wanted[keep]
                    state = np.minimum(np.searchsorted(keys, wanted), keys.size - 1)
                    same = np.flatnonzero(keys[state] == wanted)
                    keep, state = keep[same], state[same]
                start, at, word = start[keep], at[keep], word[keep]
                k += 1
                if not start.size:
                    break
            at = at + trie["moves"][j][word]
        if not start.size:
            return start, start
        begin, end = trie["ends"][state], trie["ends"][state + 1]
        n = end - begin
        entry = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(start, n) - trie["offset"][entry], trie["item"][entry]

    def search(self, texts: list[str | None]) -> list[dict[int, tuple[int, int, int]]]:
        """For each whole text: {item: (edits, first word, last word)} of its best match, for items found."""
        docs = [words_of(t) for t in texts]
        found: list[dict[int, tuple[int, int, int]]] = [{} for _ in docs]
        sizes = np.array([len(d) for d in docs], np.int64)
        n = int(sizes.sum())
        if not self.tries or not n:
            return found
        flat = np.zeros(n + 2 * CLASSES[-1] + MIN_WORDS, np.int32)
        flat[:n] = list(map(self.vocab.get, chain.from_iterable(docs), repeat(0)))
        opens = np.cumsum(sizes) - sizes
        known = np.flatnonzero(flat)  # places stay 64 bits wide: a pair is place x items
        pairs = [np.empty(0, np.int64)]
        for begin in range(0, known.size, PIECE):
            start = known[begin : begin + PIECE]
            for trie in self.tries:
                place, item = self._candidates(trie, flat, start)
                pairs.append((place + self.longest) * len(self.items) + item)  # a place may lie before the text
        pair = np.unique(np.concatenate(pairs))
        place, item = pair // len(self.items) - self.longest, pair % len(self.items)
        # with edits at its start, a window may seem to begin in the text before
        first = np.maximum(np.searchsorted(opens, place, side="right") - 1, 0)
        last = np.maximum(np.searchsorted(opens, place + self.size[item] + np.array(self.most, np.int64)[item], side="left") - 1, first)
        words, seen = flat.tolist(), {}
        for place, item, first, last in zip(place.tolist(), item.tolist(), first.tolist(), last.tolist()):
            ws, most = self.ids[item], self.most[item]
            for doc in range(first, last + 1):
                base, size = int(opens[doc]), int(sizes[doc])
                low, high = max(place - base - most, 0), min(place - base + len(ws) + most, size)
                got, tried = found[doc].get(item), seen.get((doc, item), (0, 0))
                if low >= high or (got and got[0] == 0) or (tried[0] <= low and high <= tried[1]):
                    continue
                text = words[base + low : base + high]
                if len(self.sets[item].intersection(text)) < len(self.sets[item]) - most:  # each edit takes one word away at most
                    continue
                seen[doc, item] = (low, high)
                edits, last = best_match(ws, text)
                if edits <= most and (got is None or edits < got[0]):
                    back = best_match(ws[::-1], text[last::-1], from_start=True)[1]
                    found[doc][item] = (edits, low + last - back, low + last)
        return found


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark's items, a bounded block at a time."""
    items = benchmark.where("text is not null").select(F.col("item_id").try_cast("long").alias("item_id"), "text")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(chars / BLOCK_CHARS))
    for k in range(n):
        rows = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r["item_id"], r["text"]) for r in rows.orderBy("item_id", "text").collect()]


def _searcher(spark: SparkSession, items: list[tuple[int | None, str]], **how):
    """A function for Python workers that gives each its index, built once in a worker."""
    sent, token = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    return lambda: kept(f"benchmark {token}", lambda: Index(sent.value, **how))


def find_items(documents: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """(doc_id, item_id, edits, item_words, first_word, last_word): the best match of each item found in a document."""
    small_batches(documents.sparkSession)
    parts = []
    for items in _blocks(benchmark):
        index = _searcher(documents.sparkSession, items, **how)

        def matches(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for batch in batches:
                own, rows = index(), []
                for doc, hits in zip(batch["doc_id"].tolist(), own.search(batch["text"].tolist())):
                    for i, (edits, first, last) in sorted(hits.items()):
                        rows.append((None if doc is None else int(doc), own.items[i][0], edits, len(own.ids[i]), first, last))
                columns = list(zip(*rows)) or [[]] * 6
                yield pd.DataFrame({f.name: pd.array(list(c), dtype="Int64" if f.dataType == T.LongType() else "Int32") for f, c in zip(MATCH, columns)})

        parts.append(documents.select(F.col("doc_id").try_cast("long").cast("string").alias("doc_id"), "text").mapInPandas(matches, MATCH))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _clean(index):
    @F.pandas_udf(T.BooleanType())
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not hits for hits in index().search(texts.tolist())], dtype=bool)

    return clean


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``documents`` without the rows in whose text any item is found."""
    small_batches(documents.sparkSession)
    left = None
    for items in _blocks(benchmark):  # a table between passes: one index in a worker at a time
        left = (documents if left is None else written(left, "decontaminated")).where(_clean(_searcher(documents.sparkSession, items, **how))("text"))
    return left


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
