"""BPE as a streaming transducer with bounded lookahead, and an incremental decoder.

``lookahead`` is computed from the merge list. Take two texts that agree up to some place and apply the merges rank by
rank. Their segmentations agree left of a frontier, which starts at that place. Rule (a, b) can move it only where the
last agreed token is a and a token b begins at the frontier in one text alone; it then moves by len(a), to the start of
a. The next rule (a', b') that moves it needs a b' that begins there, so a is on the left spine of b'; and its rank is
higher. The longest such chain of rules, weighed by len(a), bounds how far any text to come can reach back:

    S(r) = len(a) + max(0, S(q) for rules q before r whose left part is on the left spine of b)

Tokens that end further back than the largest S, and the last symbol with its word-end mark, are final: they are
emitted and forgotten, since text right of a final boundary is merged as if it stood alone.

A text comes in pieces. No word spans a blank, so what stands before the last one is cut into words, and every word goes
through ``WordStream``; a bounded store of words met before is a shortcut to what came out of it. Within a chunk that
goes on for over ``LONG`` signs without a blank, text is normalised up to a place where no later sign can combine, and a word that does not end is
emitted while it comes. So memory does not grow with the text, unless it is one letter under endless accents.

Decoding is a machine over bytes: blocks of any size go in, text comes out, an unfinished character waits.

The merge loop needs every rule to come after the rules that made its parts, which is checked at loading.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from motionmill.llm._shared import kept, small_batches, table

_SHIFT = 20
_NONE = 1 << 60
#: Words kept with their ids in a Python worker; the store is emptied when full.
CACHE_WORDS = 200_000
#: Signs of a text taken in at once; signs of a chunk or word beyond which it is not awaited whole.
PIECE, LONG = 1 << 16, 1 << 12
#: Bytes that the decoder takes at once.
BLOCK = 1 << 12
#: Texts in these signs need no Unicode tables to normalise and split.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]*")


def _byte_signs() -> dict[int, str]:
    """The printable sign that byte-level vocabularies write for each byte: itself, or the next from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """A merge list over bytes, with ids from the vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str = ""):
        signs = _byte_signs()
        self.first = [vocab[signs[b]] for b in range(256)]
        self.final = [vocab[signs[b] + suffix] for b in range(256)]
        size = {i: 1 for i in self.first} | {i: 1 for i in self.final}
        self.pairs: dict[int, int] = {}
        left: dict[int, int] = {}
        made = {i: -1 for i in size}
        best: dict[int, int] = {}
        reach = 0
        for rank, (a, b) in enumerate(merges):
            x, y, new = vocab[a], vocab[b], vocab[a + b]
            if made[x] >= rank or made[y] >= rank or new in left:
                raise ValueError("merges must follow those that make their parts, each making a new token")
            made[new], left[new], size[new] = rank, x, size[x] + size[y]
            self.pairs[x << _SHIFT | y] = rank << _SHIFT | new
            far, t = 0, y
            while t is not None:
                far, t = max(far, best.get(t, 0)), left.get(t)
            best[x] = max(best.get(x, 0), size[x] + far)
            reach = max(reach, best[x])
        self.size = size
        self.lookahead = reach + 1

    def merge(self, ids: list[int]) -> list[int]:
        """All merges of ``ids``, lowest rank first, leftmost first."""
        if len(ids) > 128:
            return self._merge_many(ids)
        get = self.pairs.get
        keys = [get(a << _SHIFT | b, _NONE) for a, b in zip(ids, ids[1:])]
        while keys:
            best = min(keys)
            if best == _NONE:
                break
            i = keys.index(best)
            ids[i] = best & ((1 << _SHIFT) - 1)
            del ids[i + 1], keys[i]
            if i:
                keys[i - 1] = get(ids[i - 1] << _SHIFT | ids[i], _NONE)
            if i < len(keys):
                keys[i] = get(ids[i] << _SHIFT | ids[i + 1], _NONE)
        return ids

    def _merge_many(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs, for long words; a pair that changed meanwhile is passed over."""
        get, n = self.pairs.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(key, i) for i in range(n - 1) if (key := get(ids[i] << _SHIFT | ids[i + 1]))]
        heapify(heap)
        while heap:
            key, i = heappop(heap)
            j = after[i]
            if j >= n or ids[i] < 0 or get(ids[i] << _SHIFT | ids[j]) != key:
                continue
            ids[i], ids[j], after[i] = key & ((1 << _SHIFT) - 1), -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if key := get(ids[i] << _SHIFT | ids[after[i]]):
                    heappush(heap, (key, i))
            if before[i] >= 0 and (key := get(ids[before[i]] << _SHIFT | ids[i])):
                heappush(heap, (key, before[i]))
        return [i for i in ids if i >= 0]

    def stream(self, pieces: Iterable[bytes]) -> Iterator[int]:
        """Ids of one word that comes in pieces."""
        word = WordStream(self)
        for piece in pieces:
            yield from word.feed(piece)
        yield from word.finish()

    def word(self, word: bytes) -> list[int]:
        stream = WordStream(self)
        return stream.feed(word) + stream.finish()


class WordStream:
    """One word whose bytes come in pieces; holds a few times ``lookahead`` bytes however long the word is."""

    def __init__(self, merges: Merges):
        self.merges, self.held = merges, b""

    def feed(self, piece: bytes) -> list[int]:
        """Ids that no bytes to come can change."""
        ids, look = [], self.merges.lookahead
        for at in range(0, len(piece), 2 * look):
            self.held += piece[at : at + 2 * look]
            if len(self.held) < 3 * look:
                continue
            done, stable = 0, len(self.held) - look
            for i in self.merges.merge([self.merges.first[b] for b in self.held]):
                if done + self.merges.size[i] > stable:
                    break
                done += self.merges.size[i]
                ids.append(i)
            self.held = self.held[done:]
        return ids

    def finish(self) -> list[int]:
        held, self.held = self.held, b""
        return self.merges.merge([self.merges.first[b] for b in held[:-1]] + [self.merges.final[held[-1]]]) if held else []


class WordBpe:
    """Encoder and decoder of a vocabulary file with word ends: lower case, white space dropped."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.merges = Merges(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre = library.normalizer, library.pre_tokenizer
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.byte = {s: b for b, s in _byte_signs().items()}
        surface = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.surface = [surface[i].encode() for i in range(len(surface))]
        self.number = [str(i) for i in range(len(surface))]
        self.id = list(range(len(surface)))  # one number object for each id, shared by all stores
        self.known: dict[str, tuple[int, ...]] = {}

    def words_in(self, normal: str) -> list[tuple[str, int, int]]:
        """(word, begin, end) in a normalised text, by the library's own Unicode tables."""
        return [(bytes(map(self.byte.__getitem__, w)).decode(), a, b) for w, (a, b) in self.pre.pre_tokenize_str(normal)]

    def _split(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return self.words.findall(text.lower())
        return [w for w, _, _ in self.words_in(self.normalizer.normalize_str(text))]

    def word(self, word: str) -> tuple[int, ...]:
        ids = self.known.get(word)
        if ids is None:
            ids = tuple(map(self.id.__getitem__, self.merges.word(word.encode())))
            if len(word) <= 64:
                if len(self.known) >= CACHE_WORDS:
                    self.known.clear()
                self.known[word] = ids
        return ids

    def whole(self, text: str) -> list[int]:
        """Ids of a text that a blank or the end follows."""
        ids: list[int] = []
        for i, part in enumerate(self.split_special.split(text) if "<|" in text else [text]):
            if i % 2:
                ids.append(self.special[part])
                continue
            words = self._split(part)
            got = list(map(self.known.get, words))
            if None in got:
                got = [self.word(words[k]) if g is None else g for k, g in enumerate(got)]
            ids += chain.from_iterable(got)
        return ids

    def encode_pieces(self, pieces: Iterable[str]) -> Iterator[list[int]]:
        coder = Transducer(self)
        for piece in pieces:
            yield coder.feed(piece)
        yield coder.finish()

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.encode_pieces(pieces_of(text))))

    def decode(self, ids: Iterable[int], at_once: int = 4096) -> Iterator[str]:
        """Text of ``ids``, tokens parted by one blank, in pieces."""
        decoder, ids = Decoder(self.surface), list(ids)
        for at in range(0, len(ids), at_once):
            yield decoder.feed(ids[at : at + at_once])
        yield decoder.finish()

    def digest(self, text: str, every: list[int] | None = None) -> tuple[int, str, str]:
        """Number of ids, digest of the ids and of what they decode to; ids are hashed, decoded and dropped as they come, or added to ``every``."""
        n, said, shown, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(self.surface)
        for ids in self.encode_pieces(pieces_of(text)):
            if ids:
                said.update(((" " if n else "") + " ".join(map(self.number.__getitem__, ids))).encode())
                shown.update(decoder.feed(ids).encode())
                n += len(ids)
                if every is not None:
                    every += ids
        shown.update(decoder.finish().encode())
        return n, said.hexdigest(), shown.hexdigest()


def pieces_of(text: str) -> Iterator[str]:
    return (text[i : i + PIECE] for i in range(0, len(text), PIECE))


class Transducer:
    """A text's ids while it comes in pieces: ``feed`` gives those that no text to come can change, ``finish`` the rest."""

    def __init__(self, bpe: WordBpe):
        self.bpe, self.held = bpe, ""
        self.run: LongChunk | None = None

    def feed(self, piece: str) -> list[int]:
        ids: list[int] = []
        if self.run is not None:
            at = piece.find(" ")
            if at < 0:
                return self.run.feed(piece)
            ids, piece, run, self.run = self.run.feed(piece[:at]), piece[at + 1 :], self.run, None
            ids += run.finish()
        whole, _, self.held = (self.held + piece).rpartition(" ")
        ids += self.bpe.whole(whole)
        if len(self.held) > LONG:
            self.run, text, self.held = LongChunk(self.bpe), self.held, ""
            ids += self.run.feed(text)
        return ids

    def finish(self) -> list[int]:
        held, run, self.held, self.run = self.held, self.run, "", None
        return run.finish() if run is not None else self.bpe.whole(held)


class LongChunk:
    """A chunk without blanks that does not end soon: normalised, cut into words and encoded while it comes."""

    HOLD = 24  # more than a special token's signs

    def __init__(self, bpe: WordBpe):
        self.bpe, self.raw, self.tail = bpe, "", ""
        self.word: WordStream | None = None
        self.lead = ""

    def feed(self, text: str) -> list[int]:
        raw = self.raw + text
        at = len(raw) - self.HOLD
        while at > 0 and not begins_anew(raw[at]):
            at -= 1
        at = max(at, 0)
        for m in self.bpe.split_special.finditer(raw):
            if m.start() < at < m.end():
                at = m.start()
        self.raw = raw[at:]
        return self._sections(raw[:at])

    def finish(self) -> list[int]:
        raw, self.raw = self.raw, ""
        return self._sections(raw) + self._close()

    def _sections(self, text: str) -> list[int]:
        ids: list[int] = []
        for i, part in enumerate(self.bpe.split_special.split(text)):
            ids += [*self._close(), self.bpe.special[part]] if i % 2 else self._words(self.bpe.normalizer.normalize_str(part))
        return ids

    def _words(self, normal: str) -> list[int]:
        """Words that are certain: those that end before the text does and leave room for the longest ending of the split pattern, three signs."""
        ids: list[int] = []
        if self.word is not None:
            goes_on = self.bpe.words_in(self.lead + normal)[0][2] - 1
            ids += self.word.feed(normal[:goes_on].encode())
            if goes_on == len(normal):
                return ids
            ids += self.word.finish()
            self.word, normal = None, normal[goes_on:]
        text, self.tail = self.tail + normal, ""
        for word, begin, end in self.bpe.words_in(text):
            if begin > len(text) - 3 or end == len(text):
                self.tail = text[begin:]
                break
            ids += self.bpe.word(word)
        if len(self.tail) > LONG:  # one word, of letters or of other signs
            self.lead = "a" if len(self.bpe.words_in("a" + self.tail[0])) == 1 else "!"
            self.word = WordStream(self.bpe.merges)
            ids += self.word.feed(self.tail.encode())
            self.tail = ""
        return ids

    def _close(self) -> list[int]:
        ids = self.word.finish() if self.word is not None else []
        for word, _, _ in self.bpe.words_in(self.tail):
            ids += self.bpe.word(word)
        self.word, self.tail = None, ""
        return ids


@lru_cache(maxsize=1)
def _seconds() -> set[str]:
    """Signs that can combine with the one before them though they are no accents: second parts of decompositions, vowels and finals of Hangul."""
    parts = (unicodedata.decomposition(chr(c)) for c in range(0x110000))
    return {chr(int(d.split()[-1], 16)) for d in parts if d and d[0] != "<"} | {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}


def begins_anew(sign: str) -> bool:
    """Whether text may be cut before ``sign`` and both sides be normalised alone."""
    if sign.isascii():
        return True
    first = unicodedata.normalize("NFD", sign)[0]
    return unicodedata.combining(first) == 0 and first not in _seconds()


class ByteMachine:
    """UTF-8 bytes in blocks of any size to text as it becomes certain; bytes that are no UTF-8 give U+FFFD."""

    def __init__(self):
        self.held = b""

    def feed(self, block: bytes) -> str:
        data = self.held + block
        end = len(data) - self._unfinished(data)
        self.held = data[end:]
        return data[:end].decode("utf-8", "replace")

    def finish(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many of the last bytes begin a character that needs more."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                return 0
            if byte >= 0xC0:
                return back if back < (2 if byte < 0xE0 else 3 if byte < 0xF0 else 4) else 0
        return 0


class Decoder:
    """Ids to text: the tokens' bytes, parted by blanks, pass the byte machine in blocks."""

    def __init__(self, surface: list[bytes], between: bytes = b" "):
        self.surface, self.between, self.begun, self.machine = surface, between, False, ByteMachine()

    def feed(self, ids: list[int]) -> str:
        data = self.between.join(map(self.surface.__getitem__, ids))
        if self.begun and ids:
            data = self.between + data
        self.begun = self.begun or bool(ids)
        return "".join([self.machine.feed(data[i : i + BLOCK]) for i in range(0, len(data), BLOCK)])

    def finish(self) -> str:
        return self.machine.finish()


def bytes_to_text(pieces: Iterable[bytes]) -> Iterator[str]:
    """Text of a byte stream as it becomes certain."""
    machine = ByteMachine()
    for piece in pieces:
        if text := machine.feed(piece):
            yield text
    if text := machine.finish():
        yield text


def word_bpe(path: str) -> WordBpe:
    """One per Python worker."""
    return kept(f"word-bpe {path}", lambda: WordBpe(path))


def encode_texts(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` (array of int) of each whole text; null texts count as empty, other columns and rows stay, a column ``ids`` is replaced."""
    small_batches(df.sparkSession)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pd.Series) -> pd.Series:
        bpe = word_bpe(path)
        return pd.Series([bpe.encode(t or "") for t in texts], dtype=object)

    return df.withColumn("ids", ids(F.col(text)))


def decode_ids(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text of ``ids``; a column of that name is replaced."""
    small_batches(df.sparkSession)

    @F.pandas_udf(T.StringType())
    def decoded(rows: pd.Series) -> pd.Series:
        bpe = word_bpe(path)
        return pd.Series(["" if r is None else "".join(bpe.decode(r)) for r in rows], dtype=object)

    return df.withColumn("decoded", decoded(F.col(ids)))


def round_trip(df: DataFrame, path: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """``df`` without ``text`` and with n_tokens, ids_sha256, decoded_sha256 and, if asked, ids; all from one pass.

    Columns of these names are replaced; all others stay.
    """
    small_batches(df.sparkSession)
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids
    kinds = [T.LongType(), T.StringType(), T.StringType(), T.ArrayType(T.IntegerType())]

    @F.pandas_udf(T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]))
    def digest(texts: pd.Series) -> pd.DataFrame:
        bpe, rows = word_bpe(path), []
        for t in texts:
            ids: list[int] | None = [] if keep_ids else None
            row = bpe.digest(t or "", ids)
            rows.append((*row, ids) if keep_ids else row)
        return pd.DataFrame(rows, columns=names)

    stay = [F.col(f"`{c}`") for c in df.columns if c not in {text, *names}]
    told = df.select(digest(F.col(text)).alias("told"), *([F.struct(*stay).alias("row")] if stay else []))
    return told.select(*(["row.*"] if stay else []), "told.*")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
