"""Token ids as Re-Pair grammars, one file per stretch of documents, with random access.

Documents are range-partitioned by id; partition p is shard p. Within a shard, documents in ascending order (nulls
first; rows of one id by a hash of the text, so that they may span shards) fill files of about ``FILE_TOKENS`` ids, so
that a task holds one file at a time. Each file is a grammar of its own: in rounds, the most frequent pairs of
neighbouring ids that stand at least ``MIN_COUNT`` times, up to ``PAIRS_A_ROUND``, are replaced by new nonterminals,
until no such pair is left. No pair spans two documents, so every document is a run of symbols of
its own, and with the expansion length of each symbol any document, or any place in one, is decoded alone.

A file is a row of a Parquet table in the shared folder: shard, file, doc_ids, ends (symbols up to each document's
end), tokens (ids per document), rules (pairs), lengths (of rules), symbols, first_id (the least nonterminal) and
n_tokens; number lists are little-endian 32-bit binary.

A null text is an empty one and gets the end id alone. Repeated ids and rows are kept, side by side. An empty table
gives an empty set of files. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain, count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from motionmill.llm._shared import kept, small_batches, table, written

FILE_TOKENS = 1 << 19
MIN_COUNT = 16
PAIRS_A_ROUND = 1 << 14
END_ID = 2
#: Chunks that a Python worker keeps; when it is full, those that only one batch had leave the store.
CACHE_CHUNKS = 600_000
#: Bytes of text that are encoded at once, at least: what stands in them often is looked up once.
GROUP_BYTES = 1 << 23
#: Pieces in one call of the library.
PIECES_A_CALL = 64
_BLANK_INSIDE = re.compile(r" (?<=\S )(?=\S)")
_SPACE = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: A blank that may not begin a piece: space stands before it, and space or nothing behind it.
_UNSURE_BLANK = f"{_SPACE} (?:{_SPACE}|\\z)"
_LETTER, _NUMBER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Chunks of signs whose class all Unicode versions agree on, without space at the front.
_LATIN = re.compile("[!-~\xa1-\u024f][\n -~\xa1-\u024f]*")
#: The vocabulary's split pattern, for such chunks.
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\\s{_LETTER}{_NUMBER}]+|\\s+(?!\\S)|\\s+")
FILES = "shard int, file int, doc_ids array<bigint>, ends binary, tokens binary, rules binary, lengths binary, symbols binary, first_id int, n_tokens bigint"


def repair(ids: np.ndarray, closes: np.ndarray, first_id: int, min_count: int = MIN_COUNT, width: int = PAIRS_A_ROUND) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, closes, rules, lengths) of ``ids``; ``closes`` marks the last id of each document.

    Where chosen pairs overlap, every second one from the left is taken.
    """
    seq, closes = ids.astype(np.int64), closes.copy()
    rules, lengths = np.empty((0, 2), np.int64), np.empty(0, np.int64)
    open_ = ~closes[:-1]  # where a pair stands that may be frequent
    while open_.any():
        at = np.flatnonzero(open_)
        bits, room = int(first_id + len(rules)).bit_length(), int(seq.size).bit_length()
        pairs = seq[at] << bits | seq[at + 1]
        if 2 * bits + room < 64:  # pair and place in one number
            ordered = np.sort(pairs << room | at)
            pairs, at = ordered >> room, ordered & ((1 << room) - 1)
        else:
            order = np.argsort(pairs, kind="stable")
            pairs, at = pairs[order], at[order]
        start = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
        times = np.diff(start, append=at.size)
        frequent = np.flatnonzero(times >= min_count)
        if not frequent.size:
            break
        chosen = np.sort(frequent[np.argsort(-times[frequent], kind="stable")[:width]])
        rule_of = np.full(times.size, -1, np.int32)
        rule_of[chosen] = np.arange(chosen.size)
        rule = np.full(seq.size, -1, np.int32)
        rule[at] = np.repeat(rule_of, times)
        again = np.zeros(seq.size, bool)  # frequent pairs that stay, unlike rare ones, may be frequent in the next round
        again[at] = np.repeat(times >= min_count, times)
        hit = np.flatnonzero(rule >= 0)
        opens = np.concatenate(([True], np.diff(hit) > 1))
        run = hit[np.maximum.accumulate(np.where(opens, np.arange(hit.size), 0))]
        hit = hit[np.flatnonzero((hit - run) & 1 == 0)]
        base = first_id + len(rules)
        size = lambda x: np.where(x < first_id, 1, lengths[np.maximum(x - first_id, 0)] if len(lengths) else 1)
        new = np.stack((pairs[start[chosen]] >> bits, pairs[start[chosen]] & ((1 << bits) - 1)), axis=1)
        lengths = np.concatenate((lengths, size(new[:, 0]) + size(new[:, 1])))
        rules = np.concatenate((rules, new))
        seq[hit] = base + rule[hit]
        closes[hit] = closes[hit + 1]
        keep = np.ones(seq.size, bool)
        keep[hit + 1] = False
        kept_at = np.flatnonzero(keep)
        seq, closes, again = seq[kept_at], closes[kept_at], again[kept_at]
        fresh = seq >= base
        open_ = (again[:-1] | fresh[:-1] | fresh[1:]) & ~closes[:-1]
    return seq, closes, rules, lengths


def _stretches(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of stretches end to end; each begins at ``begin`` and has ``n``."""
    stop = np.cumsum(n)
    small = not n.size or max(stop[-1], begin.max() + n.max()) < 1 << 31
    out = np.repeat((begin - (stop - n)).astype(np.int32 if small else np.int64), n)
    out += np.arange(out.size, dtype=out.dtype)
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first_id: int) -> np.ndarray:
    """The ids behind ``symbols``. All rules are opened at once, a level at a time; then each symbol takes its stretch."""
    starts = np.cumsum(lengths) - lengths
    flat = np.arange(first_id, first_id + len(rules))
    while (inner := flat >= first_id).any():
        n = np.where(inner, 2, 1)
        place = (np.cumsum(n) - n)[inner]
        parts = rules[flat[inner] - first_id]
        flat = np.repeat(flat, n)
        flat[place], flat[place + 1] = parts[:, 0], parts[:, 1]
    literal = np.arange(first_id)
    begin, size = np.concatenate((flat.size + literal, starts)), np.concatenate((np.ones(first_id, np.int64), lengths))
    return np.concatenate((flat, literal))[_stretches(begin[symbols], size[symbols])]


class ChunkEncoder:
    """The library's encoder with a bounded store of what it gave for blank-separated chunks.

    A blank always begins a piece of the vocabulary's split pattern where one of its neighbours is no space, so a text
    may be cut there. A chunk that is not in the store and holds only signs of ``_LATIN`` is split into pieces here; the
    library's model then merges each distinct piece once, many in a call, which spares most of the library's time a chunk.
    Other chunks pass the whole library. The store holds ids end to end, so that those of a batch are gathered at once.
    """

    FIRST = "\udfff"  # marks a text's first chunk, which no blank precedes; no text holds this sign

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.model = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.model.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self.special = re.compile("|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()) or r"(?!)")
        vocabulary = self.library.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.n_bytes[list(vocabulary.values())] = list(map(len, vocabulary))  # a sign of the byte alphabet is a byte
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = np.empty(256, "<u2")
        self.alphabet[shown], self.alphabet[[b for b in range(256) if b not in shown]] = shown, np.arange(256, 512 - len(shown))
        self.alphabet[:2] = ord(" "), ord("\n")  # bounds of pieces and calls
        self.known: dict[str, int] = {}
        self.ids, self.size, self.uses = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int32)

    def _forget(self) -> None:
        """Keeps what several batches asked for, the most used first, up to half the store."""
        keep = np.flatnonzero(self.uses > 1)
        keep = keep[np.argsort(-self.uses[keep], kind="stable")[: CACHE_CHUNKS // 2]]
        keep = np.sort(keep[np.cumsum(self.size[keep]) <= 4 * CACHE_CHUNKS])
        names = list(self.known)
        self.known = dict(zip([names[i] for i in keep.tolist()], count()))
        self.ids = self.ids[_stretches((np.cumsum(self.size) - self.size)[keep], self.size[keep])]
        self.size, self.uses = self.size[keep], np.ones(keep.size, np.int32)

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(chunks of all texts end to end, without the blanks between; number of chunks of each text, at least 1)."""
        unsure = pc.match_substring_regex(texts, _UNSURE_BLANK)
        if pc.any(unsure).as_py():
            lists = pa.array([_BLANK_INSIDE.split(t) if u else t.split(" ") for t, u in zip(texts.to_pylist(), unsure.to_pylist())], pa.large_list(pa.large_string()))
        else:
            lists = pc.split_pattern(texts, " ")
        return lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)

    def _counts(self, ids: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
        """How many of ``ids`` each of the stretches of ``n_bytes`` has, that they stand for in order."""
        have, want = np.cumsum(self.n_bytes[ids]), np.cumsum(n_bytes)
        upto = np.searchsorted(have, want, side="left") + (want > 0)
        if want.size and (upto[-1] != ids.size or not np.array_equal(np.concatenate(([0], have))[upto], want)):
            raise ValueError("ids do not end where chunks end")
        return np.diff(upto, prepend=0)

    def _by_pieces(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces = _PIECE.findall(" " + " ".join(chunks))
        number = dict(zip(dict.fromkeys(pieces), count()))
        distinct = list(number)
        raw = np.frombuffer("\x01".join("\0".join(distinct[i : i + PIECES_A_CALL]) for i in range(0, len(distinct), PIECES_A_CALL)).encode(), np.uint8)
        calls = self.alphabet[raw].tobytes().decode("utf-16-le").split("\n")
        got = self.model.encode_batch_fast(calls, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable([e.ids for e in got]), np.int32)
        n = self._counts(ids, np.diff(np.flatnonzero(np.concatenate((raw < 2, [True]))), prepend=-1) - 1)
        place = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
        ids = ids[_stretches((np.cumsum(n) - n)[place], n[place])]
        return ids, self._counts(ids, np.fromiter(map(len, map(str.encode, chunks)), np.int64, len(chunks)) + 1)

    def _learn(self, chunks: list[str]) -> None:
        latin, other = [], []
        for c in chunks:
            (latin if _LATIN.fullmatch(c) else other).append(c)
        if self.special.search(" ".join(latin)):
            other += [c for c in latin if self.special.search(c)]
            latin = [c for c in latin if not self.special.search(c)]
        lists = [e.ids for e in self.library.encode_batch_fast([c[1:] if c[:1] == self.FIRST else " " + c for c in other], add_special_tokens=False)]
        ids, n = self._by_pieces(latin) if latin else (self.ids[:0], self.size[:0])
        self.known.update(zip(chain(latin, other), count(len(self.known))))
        self.ids = np.concatenate((self.ids, ids, np.fromiter(chain.from_iterable(lists), np.int32)))
        self.size = np.concatenate((self.size, n, np.fromiter(map(len, lists), np.int64)))
        self.uses = np.concatenate((self.uses, np.zeros(len(chunks), np.int32)))

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each)."""
        if len(self.known) > CACHE_CHUNKS or self.ids.size > 8 * CACHE_CHUNKS:
            self._forget()
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        chunks, n = self._cut(texts)
        stop = np.cumsum(n)
        coded = chunks.dictionary_encode()
        keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        n_chunks = len(keys)
        keys += [self.FIRST + c for c in chunks.take(pa.array(stop - n)).to_numpy(zero_copy_only=False)]
        places = np.array(list(map(self.known.get, keys, repeat(-1))), np.int64)
        missing = np.flatnonzero(places < 0)
        if missing.size:
            new = [keys[i] for i in missing.tolist()]
            self._learn(list(dict.fromkeys(new)))
            places[missing] = list(map(self.known.__getitem__, new))
        self.uses[places] += 1
        place = places[coded.indices.to_numpy()]
        place[stop - n] = places[n_chunks:]
        size = self.size[place]
        ids = self.ids[_stretches((np.cumsum(self.size) - self.size)[place], size)]
        return ids, np.diff(np.cumsum(size)[stop - 1], prepend=0)


def chunk_encoder(path: str) -> ChunkEncoder:
    return kept(f"chunks {path}", lambda: ChunkEncoder(path))


def _file(shard: int, number: int, docs: list, ids: np.ndarray, tokens: np.ndarray, first_id: int) -> pa.RecordBatch:
    closes = np.zeros(ids.size, bool)
    closes[np.cumsum(tokens) - 1] = True
    symbols, closed, rules, lengths = repair(ids, closes, first_id)
    pack = lambda x: pa.array([x.astype("<i4").tobytes()])
    columns = {
        "shard": pa.array([shard], pa.int32()), "file": pa.array([number], pa.int32()), "doc_ids": pa.array([docs], pa.list_(pa.int64())), "ends": pack(np.flatnonzero(closed) + 1),
        "tokens": pack(tokens), "rules": pack(rules), "lengths": pack(lengths), "symbols": pack(symbols), "first_id": pa.array([first_id], pa.int32()), "n_tokens": pa.array([ids.size], pa.int64()),
    }
    return pa.RecordBatch.from_pydict(columns)


def write_grammars(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encodes, compresses and writes; returns the table of files, read back."""
    small_batches(df.sparkSession)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array]]:
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
            if held and (batch is None or sum(b.nbytes for b in held) >= GROUP_BYTES):
                yield [d for b in held for d in b["doc_id"].to_pylist()], pa.concat_arrays([b["text"].cast(pa.large_string()) for b in held])
                held = []

    def shard_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(path)
        first_id = encoder.library.get_vocab_size()
        shard, number, docs, ids, tokens = TaskContext.get().partitionId(), 0, [], [], []
        for named, texts in groups(batches):
            flat, n = encoder.encode(texts)
            flat, n, stop = np.insert(flat, np.cumsum(n), end_id), n + 1, np.cumsum(n + 1)
            begin = 0
            while begin < n.size:  # a file ends with the document that fills it
                room = file_tokens - sum(map(len, ids)) + (stop[begin - 1] if begin else 0)
                end = min(int(np.searchsorted(stop, room)) + 1, n.size)
                docs += named[begin:end]
                ids.append(flat[(stop[begin - 1] if begin else 0) : stop[end - 1]])
                tokens.append(n[begin:end])
                if sum(map(len, ids)) >= file_tokens:
                    yield _file(shard, number, docs, np.concatenate(ids), np.concatenate(tokens), first_id)
                    number, docs, ids, tokens = number + 1, [], [], []
                begin = end
        if docs:
            yield _file(shard, number, docs, np.concatenate(ids), np.concatenate(tokens), first_id)

    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(text).alias("h"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return written(ordered.mapInArrow(shard_files, FILES), "grammars")


def file_starts(files: DataFrame) -> DataFrame:
    """(shard, file, start): ids in all files before; shards are summed first, so no window holds all files."""
    sizes = files.select("shard", "file", F.col("n_tokens"))
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # as many rows as the write had tasks
    before = shards.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("base"))
    within = F.sum("n_tokens").over(W.partitionBy("shard").orderBy("file")) - F.col("n_tokens")
    return sizes.select("shard", "file", within.alias("inner")).join(F.broadcast(before), "shard").select("shard", "file", (F.col("base") + F.col("inner")).alias("start"))


def _unpack(row: dict) -> tuple[np.ndarray, ...]:
    get = lambda k: np.frombuffer(row[k], "<i4").astype(np.int64)
    return get("ends"), get("tokens"), get("rules").reshape(-1, 2), get("lengths"), get("symbols")


def decode_document(row: dict, at: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``stop`` of the document at place ``at`` of one file; none beyond its end.

    The stored lengths tell which of the document's symbols reach into the stretch, and which of a rule's two parts do;
    no other rule is opened.
    """
    ends, _, rules, lengths, symbols = _unpack(row)
    own = symbols[ends[at - 1] if at else 0 : ends[at]]
    first_id = row["first_id"]
    size = np.ones(own.size, np.int64)
    size[own >= first_id] = lengths[own[own >= first_id] - first_id]
    close = np.cumsum(size)
    total = int(close[-1]) if close.size else 0
    start, stop = max(start, 0), total if stop is None else min(stop, total)
    if start >= stop:
        return np.empty(0, np.int64)
    first, last = np.searchsorted(close, start, side="right"), np.searchsorted(close, stop, side="left")
    out, place = [], int(close[first] - size[first])
    stack = own[first : last + 1][::-1].tolist()
    while stack:
        symbol = stack.pop()
        n = int(lengths[symbol - first_id]) if symbol >= first_id else 1
        if place + n <= start or place >= stop:
            place += n
        elif symbol >= first_id:
            left, right = rules[symbol - first_id].tolist()
            stack += [right, left]
        else:
            out.append(symbol)
            place += 1
    return np.array(out, np.int64)


def read_grammars(files: DataFrame) -> DataFrame:
    """(doc_id, shard, file, inner, n_tokens, ids_crc32) of every document, from the files; ``inner`` counts within the file."""
    small_batches(files.sparkSession)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in chain.from_iterable(batch.to_pylist() for batch in batches):
            _, tokens, rules, lengths, symbols = _unpack(row)
            raw = memoryview(expand(symbols, rules, lengths, row["first_id"]).astype("<u4").tobytes())
            stop = np.cumsum(tokens)
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((stop - tokens).tolist(), stop.tolist())]
            same = lambda x: pa.array(np.full(tokens.size, x, np.int32))  # noqa: B023, E731
            columns = {"doc_id": pa.array(row["doc_ids"], pa.int64()), "shard": same(row["shard"]), "file": same(row["file"]), "inner": stop - tokens, "n_tokens": tokens, "ids_crc32": np.array(crc, np.int64)}
            yield pa.RecordBatch.from_pydict(columns)

    return files.mapInArrow(documents, "doc_id bigint, shard int, file int, inner bigint, n_tokens bigint, ids_crc32 bigint")


def op6_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = write_grammars(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_grammars(files).join(file_starts(files), ["shard", "file"]).select("doc_id", (F.col("start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
