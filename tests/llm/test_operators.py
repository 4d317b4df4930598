"""Operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from motionmill.llm import bpe, chat, decontaminate as dec, jpeg, langid, media, pii, repair, sharding, simhash, toxicity, trie, urls, whiten

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is it that was for on are with as his they be at one have this from or had by hot word but what some".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "ing", "ed", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(0)
    out = [prose(rng, n) for n in (3, 40, 40, 200, 900)]
    out += [None, "", " \n\t ", "one", "two words", "a\u00a0b É漢字 😀 \x00\x01", out[3], out[3] + " end", "x" * 5000, "İΣσς 'll 12 <|endoftext|> ﬁ"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, "nameless text", None, None, None), (1, texts[1], "en", "s", 1)]
    return spark.createDataFrame(rows, DOCS).withColumns({"fp": F.lit("clash"), "key": F.lit(1), "part": F.lit(2), "terms": F.lit("clash")})


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.where("false")


# ---------------------------------------------------------------- 1


def test_chat_reads_back_what_it_wrote(spark):
    hard = ["\\### Assistant: </turn> ok", "###", "\\0\\1", "</turn>\n### user: x", "", None, "~#<:\\"]
    rows = [(1, i, None if i == 0 else i - 1, ["user", "assistant", "a:b", None][i % 4], t, 0.0) for i, t in enumerate(hard)]
    rows += [(None, 0, None, "user", "null tree", 1.0), (2, 0, 77, "assistant", "orphan", None)]
    m = spark.createDataFrame(rows, "tree_id long, node_id int, parent_id int, role string, text string, score double").withColumn("leaf", F.lit(1))
    out = {r["tree_id"]: r for r in chat.format_trees(m).select("*", chat.parse_formatted(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("said")).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [(r[3] or "", r[4] or "") for r in rows[:7]]
    assert out[1]["said"] == "".join(r[4] or "" for r in rows[:7] if r[3] == "assistant")
    assert out[None]["n_turns"] == 1 and out[2]["said"] == "orphan"


def test_chat_paths_and_ranks(spark):
    rng = random.Random(1)
    parents = [None] + [rng.randrange(i) for i in range(1, 40)]
    scores = [rng.randrange(5) for _ in parents]
    m = spark.createDataFrame([(9, i, p, "user", str(i), float(s)) for i, (p, s) in enumerate(zip(parents, scores))], "tree_id long, node_id int, parent_id int, role string, text string, score double")
    paths = {}
    for leaf in set(range(40)) - {p for p in parents if p is not None}:
        path, at = [], leaf
        while at is not None:
            path.insert(0, at)
            at = parents[at]
        paths[leaf] = path
    best = sorted(paths, key=lambda x: (-sum(scores[i] for i in paths[x]), x))[:4]
    out = chat.format_trees(m, top=4).select("rank", "leaf", chat.parse_formatted(F.col("formatted"))["text"].alias("t")).orderBy("rank").collect()
    assert [r["leaf"] for r in out] == best and [[int(x) for x in r["t"]] for r in out] == [paths[b] for b in best]


def test_chat_of_nothing_and_of_circles(spark):
    kind = "tree_id long, node_id int, parent_id int, role string, text string, score double"
    assert chat.format_trees(spark.createDataFrame([], kind)).count() == 0
    with pytest.raises(ValueError):
        chat.format_trees(spark.createDataFrame([(1, 0, 1, "u", "", 0.0), (1, 1, 0, "u", "", 0.0), (1, 2, 0, "u", "", 0.0)], kind))


def test_repeated_turns_are_ordered_by_role_and_text(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, None, None)]
    out = chat.format_trees(chat.conversation_nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert out["formatted"] == "### : </turn>\n### user: a</turn>\n### user: b</turn>\n"


# ---------------------------------------------------------------- 2


def fingerprint(t):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(prints):
    """prints: {id: fingerprint}; the least id within reach of two-bit links."""
    root = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= 2 and root[j] < root[i]:
                    root[i], changed = root[j], True
    return root


def test_simhash_equals_brute_force(docs, texts):
    out = simhash.near_duplicates(docs).collect()
    prints = {i: fingerprint(t) for i, t in enumerate(texts)}
    root = roots(prints)
    assert len(out) == len(texts) + 2
    for r in out:
        if r["doc_id"] is not None:
            assert r["fp"] % (1 << 64) == prints[r["doc_id"]] and r["component_id"] == root[r["doc_id"]]
        else:
            assert r["component_id"] is None


@pytest.mark.parametrize("bucket", [1, 3, 1000])
def test_links_are_whole_at_every_bucket_size(spark, bucket):
    rng = random.Random(bucket)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1 for b in base for _ in range(25)}
    ids = dict(enumerate(sorted(prints)))
    df = spark.createDataFrame([(p - (1 << 64) * (p >> 63), i) for i, p in ids.items()], "fp long, id long")
    from motionmill.llm.components import components

    got = {r["node"]: r["root"] for r in components(simhash.fingerprint_links(df, bucket=bucket)).collect()}
    assert {i: got.get(i, i) for i in ids} == roots(ids)


def test_dedup_keeps_one_of_each_group(docs, none, texts):
    kept = simhash.drop_near_duplicates(docs)
    root = roots({i: fingerprint(t) for i, t in enumerate(texts)})
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted([(False, i) for i in set(root.values())] + [(True, 0)])
    assert simhash.drop_near_duplicates(none).count() == 0
    same = docs.limit(3).unionByName(docs.limit(3)).withColumn("tags", F.create_map(F.lit("a"), F.lit(1)))
    assert simhash.drop_near_duplicates(same).count() <= 3


# ---------------------------------------------------------------- 3


def test_payloads_come_back(texts):
    for t, r in zip(texts, media.payload_digests(texts)):
        raw = (t or "").encode()
        padded = media.pad(raw)
        assert r[:4] == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])) and len(padded) % 64 == 0 and padded
    assert media.payload_digests([texts[3]])[0] == media.payload_digests(texts)[3]


def naive_idct(c):
    out = np.zeros((8, 8))
    for y in range(8):
        for x in range(8):
            for i, p in enumerate(jpeg.ZIGZAG):
                u, v = divmod(int(p), 8)
                k = (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) / 4
                out[y, x] += k * c[i] * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * v * np.pi / 16)
    return out


@pytest.mark.parametrize("blocks", [1, 6, 7, 64 * 6, 64 * 6 + 1, 4095 * 64 * 6, 4095 * 64 * 6 + 1, 30_000_000])
def test_shapes_fit_the_format(blocks):
    wide, high = media.shape(blocks)
    assert 16 * wide <= 65_535 and 16 * high <= 65_535 and wide * high * 6 >= blocks > (wide * high - wide) * 6 - 6


def test_samples_and_chroma():
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 30, (6, 64))
    image, comps = jpeg.coefficients(jpeg.encode([(blocks, 1, 1, b"")]))[0]
    planes = [np.block([[naive_idct(blocks[0]), naive_idct(blocks[1])], [naive_idct(blocks[2]), naive_idct(blocks[3])]])] + [np.kron(naive_idct(blocks[k]), np.ones((2, 2))) for k in (4, 5)]
    y, cb, cr = (np.clip(np.round(p) + 128, 0, 255) for p in planes)
    want = np.stack((y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)), axis=2)
    assert np.abs(jpeg.rgb(image, comps) - np.clip(want, 0, 255)).max() <= 2.5


@pytest.mark.parametrize("values", [[0, 0, 0, 0, 0, 0, 0, 1], [0, 1, 2, 3], list(range(256)), [-3, 0, 0, 0, 1, -1]])
def test_coefficients_come_back(values):
    blocks = np.random.default_rng(1).choice(values, (6 * 5 * 3, 64))
    image, comps = jpeg.coefficients(jpeg.encode([(blocks, 5, 3, b"c"), (blocks[:6], 1, 1, b"")]))[0]
    grid = np.arange(15).reshape(3, 5) * 6
    assert np.array_equal(comps[1], blocks[(grid + 4).ravel()]) and np.array_equal(comps[0].reshape(3, 2, 5, 2, 64)[:, 1, :, 0], blocks[grid + 2])


def test_media_columns(spark):
    df = media.store_payload(spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string"))
    bad = df.unionByName(spark.createDataFrame([(3, "x", bytearray(b"no image")), (4, "y", None)], df.schema))
    out = {r["doc_id"]: r["tensor"] for r in media.decode_media(bad).collect()}
    assert (out[1]["height"], out[1]["width"], len(out[1]["rgb"])) == (16, 16, 768) and out[3]["rgb"] is None and out[4]["rgb"] is None


# ---------------------------------------------------------------- 4 and 6


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}


def test_bpe_equals_the_library(docs, none, texts, library):
    path, lib = public_tokenizers.path("word_bpe_49k.json"), library["word_bpe_49k.json"]
    out = {r["doc_id"]: r for r in bpe.round_trip(docs, path, keep_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert out[i]["ids"] == ids and out[i]["n_tokens"] == len(ids)
        assert out[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert out[i]["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(none, path).count() == 0


def test_stream_equals_whole_words_in_any_pieces(library):
    lib, own = library["word_bpe_49k.json"], bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(5)
    tokens = [t.replace("</w>", "") for t in lib.get_vocab() if t.isascii() and t.replace("</w>", "").isalpha() and t.islower()]
    for alphabet in ("ab", "the ing tion".replace(" ", ""), None):
        word = "".join(rng.choice(alphabet) for _ in range(7000)) if alphabet else "".join(rng.choice(tokens) for _ in range(1500))
        raw, cuts = word.encode(), sorted(rng.sample(range(len(word)), 9))
        pieces = [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)])]
        assert list(own.merges.stream(pieces)) == lib.encode(word, add_special_tokens=False).ids


def test_every_word_passes_the_transducer(library, texts, monkeypatch):
    own, met = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json")), []
    feed = bpe.WordStream.feed
    monkeypatch.setattr(bpe.WordStream, "feed", lambda self, piece: met.append(piece) or feed(self, piece))
    for t in texts:
        own.encode(t or "")
    words = {w for t in texts for w, _, _ in own.words_in(own.normalizer.normalize_str((t or "").replace("<|endoftext|>", " ")))}
    assert words and {w for w in words if len(w) <= 1000} <= {m.decode() for m in met} and all(w.encode() in b"".join(met) for w in words)


SIGNS = ["a", "b", "É", "漢", "가", "ᄀ", "ᅡ", "ᆨ", "\u0301", "\u0323", "が", "か", "\u3099", "'s", "'ll", "'", "!", "1", "<|endoftext|>", "<|", "|>", "\n", "\t", "İ", "Σ", "ﬁ", "😀", "the", " ", "\u200d"]


@pytest.mark.parametrize("size", [7, 333, 1 << 16])
def test_texts_in_pieces_equal_whole_texts(library, size):
    lib, own = library["word_bpe_49k.json"], bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(size)
    for k in range(40):
        t = "".join(rng.choice(SIGNS) for _ in range(rng.randrange(1, 400 if k % 8 else 9000)))
        t = t + "x" * 9000 + "!" * 9000 + t if k % 20 == 0 else t
        ids = lib.encode(t, add_special_tokens=False).ids
        assert [i for part in own.encode_pieces(t[i : i + size] for i in range(0, len(t), size)) for i in part] == ids
        assert "".join(own.decode(ids, 5)) == lib.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("unit", ["word and ", "x", "漢字", "a,b;"])
def test_memory_does_not_grow_with_the_text(unit):
    own = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    coder, most = bpe.Transducer(own), 0
    for _ in range(10):
        coder.feed(unit * 5_000)
        run = coder.run
        most = max(most, len(coder.held) + (len(run.raw) + len(run.tail) + (len(run.word.held) if run.word else 0) if run else 0))
    assert most < 3 * own.merges.lookahead + 2 * bpe.LONG and len(own.known) <= bpe.CACHE_WORDS


def test_bytes_to_text_waits_for_whole_characters():
    raw = "é漢😀".encode() + b"\xff" + "z".encode() + b"\xe6\xbc"
    for size in (1, 2, 3, 5):
        assert "".join(bpe.bytes_to_text(raw[i : i + size] for i in range(0, len(raw), size))) == raw.decode("utf-8", "replace")
    machine = bpe.ByteMachine()
    assert [machine.feed(bytes([b])) for b in "漢".encode()] == ["", "", "漢"]
    rng = random.Random(2)
    for _ in range(300):
        raw = bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE6, 0xBC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xFF]) for _ in range(30))
        assert "".join(bpe.bytes_to_text(raw[i : i + 4] for i in range(0, 30, 4))) == raw.decode("utf-8", "replace")


@pytest.mark.parametrize("seed", range(4))
def test_repair_expands_to_its_input(seed):
    rng = np.random.default_rng(seed)
    ids = rng.choice([3, 3, 3, 4, 5, 50_000], 3000) if seed else np.full(777, 9)
    closes = rng.random(ids.size) < 0.01
    closes[-1] = True
    symbols, closed, rules, lengths = repair.repair(ids, closes, 50_257)
    assert len(rules) and symbols.size < ids.size / 2 and np.array_equal(repair.expand(symbols, rules, lengths, 50_257), ids)
    assert closed.sum() == closes.sum() and closed[-1]


def test_grammar_files(spark, docs, none, texts, library):
    lib = library["byte_bpe_50k.json"]
    more = texts + [" a  b \n c\td", "x. y,\nz", "don't   stop\u3000now ", "a\n\nb. c"]
    df = spark.createDataFrame(list(enumerate(more)), "doc_id long, text string")
    files = repair.write_grammars(df, public_tokenizers.path("byte_bpe_50k.json"), file_tokens=500)
    out = {r["doc_id"]: r for r in repair.read_grammars(files).join(repair.file_starts(files), ["shard", "file"]).collect()}
    at = 0
    for i, t in enumerate(more):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        r = out[i]
        assert (r["start"] + r["inner"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    row = files.orderBy("shard", "file").first().asDict()
    assert repair.decode_document(row, 1).tolist() == [*lib.encode(more[row["doc_ids"][1]] or "", add_special_tokens=False).ids, 2]
    assert repair.write_grammars(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert repair.read_grammars(repair.write_grammars(docs, public_tokenizers.path("byte_bpe_50k.json"))).count() == docs.count()


class Counted:
    """The library, with the number of texts that it was asked for."""

    def __init__(self, library):
        self.library, self.n = library, 0

    def encode_batch_fast(self, texts, **how):
        self.n += len(texts)
        return self.library.encode_batch_fast(texts, **how)


def test_few_chunks_pass_the_whole_library():
    rng = random.Random(6)
    encoder = repair.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    whole = encoder.library
    encoder.library = Counted(whole)
    word = lambda: "".join(rng.choice(["th", "é", "er", "on", "ß", "9", "in"]) for _ in range(rng.randrange(1, 9))) + rng.choice(["", ",", "'s", ".\n", "%%%"])
    texts = [" ".join(word() for _ in range(400)) for _ in range(20)]
    ids, n = encoder.encode(texts)
    wanted = [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
    assert n.tolist() == list(map(len, wanted)) and ids.tolist() == sum(wanted, [])
    assert encoder.library.n <= len(texts)  # the first chunks; before, every new chunk


def test_chunks_equal_the_whole_library(monkeypatch):
    monkeypatch.setattr(repair, "CACHE_CHUNKS", 3000)
    rng, encoder = random.Random(7), repair.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    signs = [*" " * 14, *"\n\n\t\r\x0b\x0c\x1c\x1f\x85\xa0\u2003\u3000\u180e\u200b'\",.!<|>\xad×÷ªºµ²¼9٣5abcdeéßŁıǅʼnĳ漢字かñ😀\x00\x01sStT", "'s", "'ll", " <|endoftext|>", "<|endoftext|>", "   ", " \n"]
    signs += [chr(c) for c in range(0xA1, 0x250)]
    for _ in range(20):
        texts = ["".join(rng.choice(signs[: rng.choice([40, 80, len(signs)])]) for _ in range(rng.randrange(25))) for _ in range(300)]
        ids, n = encoder.encode(texts)
        wanted = [e.ids for e in encoder.library.encode_batch_fast(texts, add_special_tokens=False)]
        assert n.tolist() == list(map(len, wanted)) and ids.tolist() == sum(wanted, [])
        assert list(encoder.known.values()) == list(range(encoder.size.size))


# ---------------------------------------------------------------- 5


def test_random_access_opens_no_other_rule(spark):
    rng = random.Random(51)
    texts = [prose(rng, n) for n in (400, 3, 0, 900, 400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    row = repair.write_grammars(df, public_tokenizers.path("byte_bpe_50k.json")).collect()[0].asDict()
    assert len(row["doc_ids"]) == 5 and len(row["rules"]) > 80
    lib, lengths = library_tokens(public_tokenizers.path("byte_bpe_50k.json")), np.frombuffer(row["lengths"], "<i4")
    for at, doc in enumerate(row["doc_ids"]):
        ids = [*lib.encode(texts[doc], add_special_tokens=False).ids, 2]
        for a, b in [(0, None), (0, 1), (len(ids) - 1, len(ids)), (len(ids) // 3, len(ids) // 2), (5, 5), (len(ids), None), (7, 10**9), (-3, 4)]:
            assert repair.decode_document(row, at, a, b).tolist() == ids[max(a, 0) : b]
    # a rule that nothing of the stretch needs may be torn without harm
    symbols, ends = np.frombuffer(row["symbols"], "<i4"), np.frombuffer(row["ends"], "<i4")
    rules, need, todo = np.frombuffer(row["rules"], "<i4").reshape(-1, 2).copy(), set(), symbols[ends[0] : ends[1]].tolist()
    while todo:
        if (s := todo.pop()) >= row["first_id"] and s not in need:
            need.add(s)
            todo += rules[s - row["first_id"]].tolist()
    for k in range(len(lengths)):
        if k + row["first_id"] not in need:
            rules[k] = -1
    assert repair.decode_document({**row, "rules": rules.tobytes()}, 1).tolist() == [*lib.encode(texts[row["doc_ids"][1]], add_special_tokens=False).ids, 2]


def edit_distance(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        row = _step(row, i, x, b)
    return min(row)


def _step(row, i, x, b):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
    return new


def test_bit_vectors_equal_the_table():
    rng = random.Random(6)
    for _ in range(200):
        a, b = [rng.randrange(4) for _ in range(rng.randrange(1, 80))], [rng.randrange(4) for _ in range(rng.randrange(0, 120))]
        assert dec.best_match(a, b)[0] == edit_distance(a, b)


def edited(rng, words, k, kind, vocab):
    words = list(words)
    for _ in range(k):
        at, how = rng.randrange(len(words)), kind if kind != "mixed" else rng.choice(["changed", "added", "left out"])
        if how == "changed":
            words[at] = rng.choice(vocab)
        elif how == "added":
            words.insert(at, rng.choice(vocab))
        else:
            del words[at]
    return words


@pytest.mark.parametrize("kind", ["changed", "added", "left out", "mixed"])
@pytest.mark.parametrize("n", [8, 15, 16, 31, 32, 59])
def test_recall_by_length_and_kind_of_edit(n, kind):
    rng = random.Random(f"{n}{kind}")
    vocab = [f"w{i}" for i in range(2500)]
    items = [[rng.choice(vocab) for _ in range(n)] for _ in range(100)]
    index = dec.Index([(i, " ".join(w)) for i, w in enumerate(items)])
    docs = [[rng.choice(vocab) for _ in range(25)] + edited(rng, w, int(dec.EDITS * n), kind, vocab) + [rng.choice(vocab) for _ in range(25)] for w in items]
    found = index.search([" ".join(d) for d in docs])
    assert np.mean([i in f for i, f in enumerate(found)]) >= 0.9


def test_places_equal_the_table():
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    for _ in range(25):
        item = [rng.choice(vocab) for _ in range(rng.randrange(8, 40))]
        doc = [rng.choice(vocab) for _ in range(20)] + edited(rng, item, rng.randrange(0, int(0.2 * len(item)) + 1), "mixed", vocab) + [rng.choice(vocab) for _ in range(20)]
        found = dec.Index([(0, " ".join(item))]).search([" ".join(doc)])[0]
        if 0 in found:
            spans = {}
            for begin in range(len(doc)):
                row = list(range(len(item) + 1))
                for end, w in enumerate(doc[begin:], begin):
                    new = [row[0] + 1]
                    for i, x in enumerate(item, 1):
                        new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != w)))
                    row = new
                    spans[begin, end] = row[-1]
            least = min(spans.values())
            end = min(e for (_, e), v in spans.items() if v == least)
            assert found[0] == (least, max(b for (b, e), v in spans.items() if v == least and e == end), end)


def passage(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 6))) for _ in range(n))


def test_planted_passages_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(7)
    items = [(i, passage(rng, rng.randrange(8, 60))) for i in range(40)] + [(90, None), (91, "too short")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows, want = [(500 + i, passage(rng, 300)) for i in range(30)] + [(600, None), (601, "")], set()
    for i, t in items[:40]:
        words = t.split()
        for edits in (0, int(0.1 * len(words))):
            w = list(words)
            for p in rng.sample(range(len(w)), edits):
                w[p] = "changed"
            rows.append((len(rows), passage(rng, 80) + "\n" + " ".join(w).upper() + ". " + passage(rng, 30)))
            want.add((rows[-1][0], i))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    got = {(r["doc_id"], r["item_id"]) for r in dec.find_items(df, bench).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)
    kept = {r["doc_id"] for r in dec.drop_contaminated(df, bench).collect()}
    assert kept == {r[0] for r in rows} - {d for d, _ in got}
    assert dec.find_items(df, bench.where("false")).count() == 0 and dec.find_items(df.where("false"), bench).count() == 0


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    rng = random.Random(8)
    items = [(i, passage(rng, 30)) for i in range(12)]
    df = spark.createDataFrame([(i, passage(rng, 20) + " " + t) for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, dec.find_items(df, bench).collect()))
    monkeypatch.setattr(dec, "BLOCK_CHARS", 500)
    assert sorted(map(tuple, dec.find_items(df, bench).collect())) == whole and len(whole) == 12


def test_short_items_and_scripts_without_blanks_are_found(spark):
    rng = random.Random(15)
    han = "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(60))
    bench = spark.createDataFrame([(1, "one Red fox."), (2, "zebra"), (3, f"{han[:20]}，{han[20:45]}。{han[45:]}"), (4, "..."), (5, "seven plain words stand in this item")], "item_id long, text string")
    rows = [(1, f"{passage(rng, 30)} ONE red, fox"), (2, "one red old fox"), (3, "zebras"), (4, "the zebra"), (5, f"前{han[:30]}猫{han[31:]}後"), (6, passage(rng, 40)), (7, "one red"), (8, "fox"), (9, "so seven plain words stand in this item")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in dec.find_items(df, bench).collect()} == {(1, 1, 0), (4, 2, 0), (5, 3, 1), (9, 5, 0)}
    assert {r["doc_id"] for r in dec.drop_contaminated(df, bench).collect()} == {2, 3, 6, 7, 8}


def passages(rng, rows, n):
    """Random words in bulk: ``rows`` texts of ``n`` words out of 40,000."""
    return [" ".join(f"w{x}" for x in row) for row in rng.integers(0, 40_000, (rows, n)).tolist()]


@pytest.mark.parametrize("n_items,words,n_texts,length", [(10_000, 30, 256, 2030), (600, 40, 64, 20_000)])
def test_many_items_and_long_texts_lose_nothing(n_items, words, n_texts, length):
    rng = np.random.default_rng(5)
    items, texts = list(enumerate(passages(rng, n_items, words))), passages(rng, n_texts, length)
    index = dec.Index(items)
    planted = rng.choice(n_items, n_texts, replace=False).tolist()
    found = index.search([f"{t} {items[i][1]}" for t, i in zip(texts, planted)])
    assert [set(f) for f in found] == [{i} for i in planted]
    assert all(f[i] == (0, length, length + words - 1) for f, i in zip(found, planted))


def test_an_item_on_each_side_of_a_block_border_is_found(spark, monkeypatch):
    rng = np.random.default_rng(6)
    items = list(enumerate(passages(rng, 40, 20)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(0, " ".join(t for _, t in items)), (1, passages(rng, 1, 500)[0])], "doc_id long, text string")
    monkeypatch.setattr(dec, "BLOCK_CHARS", sum(len(t) for _, t in items) // 3)
    assert {(r["doc_id"], r["item_id"]) for r in dec.find_items(df, bench).collect()} == {(0, i) for i, _ in items}


@pytest.mark.parametrize("n", [5, 6, 7])
def test_short_items_are_found_with_their_one_edit(n):
    rng = random.Random(n)
    words = [f"w{i}" for i in range(n)]
    index = dec.Index([(1, " ".join(words))])
    for k in range(n):
        for text in (words[:k] + ["new"] + words[k + 1 :], words[:k] + words[k + 1 :], words[:k] + ["new"] + words[k:]):
            for pad in (0, 3):
                around = [f"p{rng.randrange(50)}" for _ in range(pad)]
                assert index.search([" ".join(around + text + around)])[0].get(0, (9,))[0] <= 1
    assert index.search([" ".join(["new", *words[1:-1], "new"])]) == [{}]


# ---------------------------------------------------------------- 7


def test_gradients_equal_differences():
    net = toxicity.Network({"a": 1, "b": 2}, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = ["a", "b", "cc", "ddd"]
    places, first, size = np.array([0, 1, 2, 3, 1, 0]), np.array([0, 2]), np.array([4, 3])

    def loss():
        x, mask, _ = net.gather(net.inputs(net.vectors(words)[0]).astype(np.float32), places, first, size)
        keep = []
        logit, both, weight, pooled = net.forward(x, mask, keep)
        return float((logit * [1.0, -2.0]).sum()), net.backward(x, mask, keep, both, weight, pooled, np.array([1.0, -2.0], np.float32))[0]

    _, g = loss()
    for name in ("U", "a", "c", "d"):
        at = tuple(0 for _ in net.p[name].shape)
        net.p[name][at] += 1e-2
        up = loss()[0]
        net.p[name][at] -= 2e-2
        down = loss()[0]
        net.p[name][at] += 1e-2
        assert np.isclose((up - down) / 2e-2, g[name][at], rtol=0.05, atol=2e-3), name


def test_toxic_words_are_learned_anywhere_in_a_text():
    rng = random.Random(9)
    texts, labels = [], []
    for i in range(600):
        words = prose(rng, rng.randrange(10, 200)).split()
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "nasty", "vilest", "nastily"]))
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    scorer = toxicity.Scorer(toxicity.fit(texts[:400], labels[:400], rounds=4))
    scores = scorer.score([*texts[400:], "", None])
    assert ((scores[:-2] >= toxicity.CUTOFF) == np.array(labels[400:], bool)).mean() > 0.97 and (scores[-2:] < toxicity.CUTOFF).all()
    assert np.allclose(scorer.score(texts[400:410]), scores[:10], atol=1e-6)


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 48, 49, 500):
        _, first, size = toxicity.windows(np.array([n, 5]))
        mine = [set(range(a, a + s)) for a, s in zip(first[:-1], size[:-1])]
        assert set().union(*mine) == set(range(n))


def test_one_text_of_a_repeated_id_trains(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (3, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (3, 1, 0), (None, 0, 1), (4, 0, 1)], "doc_id long, quality int, toxic int")
    assert {tuple(r) for r in toxicity.training_rows(docs, labels).collect()} <= {(1, "", 1), (3, "c", 0)}


def test_training_without_labels(spark, docs):
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    net = toxicity.train(docs, labels)
    assert net is None and toxicity.drop_toxic(docs, net).count() == docs.count()


# ---------------------------------------------------------------- 8

STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, v):
    digits = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def test_base_spans_equal_the_stated_patterns(spark):
    rng = random.Random(10)
    parts = ["a@b.c", "x.y@d", "@", ".", "1", "255", "256", "1.2.3.4", "4111 1111 1111 1111", "+33 (0)1 22-33.44 55", "é", "😀", " ", "-", "_", "0.0.0.00001", "a@b.c.d@e.f", "%", "+1", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(400)] + [None, "", "9" * 20000, "a." * 20000 + "@", "a@b" + ".c" * 20000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("value", F.lit("clash"))
    out = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["pii_base"]] for r in pii.with_base_spans(df).collect()}
    for i, t in enumerate(texts):
        assert out[i] == [(k, m.start(), m.end()) for k, p in STATED.items() for m in re.finditer(p, t or "") if holds(k, m[0])], t


def test_telling_terms(spark, none):
    rng = random.Random(11)
    rows = [(i, prose(rng, 60)) for i in range(60)]
    rows += [(100 + i, f"{prose(rng, 30)} Contact Zarquonix today at bob@ex.org or zarquonix with the {prose(rng, 30)}") for i in range(5)] + [(100, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash"))
    base, terms = pii.find_spans(df)
    found = {r["doc_id"]: r["terms"] for r in base.join(terms, "key").collect()}
    text = dict(rows)
    assert set(found) == {100 + i for i in range(5)}
    for i in range(101, 105):
        words = [text[i][s["start"] : s["end"]] for s in found[i]]
        assert {"Zarquonix", "zarquonix"} <= set(words) and not {"the", "with"} & set(words)
        clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).where("text is not null").collect()}
        assert "bob@" not in clean[i] and "[EMAIL]" in clean[i] and "arquonix" not in clean[i]
        break
    assert pii.sanitise(df).columns == df.columns and pii.sanitise(df).count() == len(rows) and pii.sanitise(none).count() == 0


@pytest.mark.parametrize("most", [100_000, 0])
def test_telling_terms_go_everywhere(spark, monkeypatch, most):
    monkeypatch.setattr(pii, "BROADCAST_TERMS", most)
    rng = random.Random(14)
    far = prose(rng, 60)
    rows = [(i, prose(rng, 60)) for i in range(400)]
    rows += [(500 + i, f"{prose(rng, 20)} Zarquonix bob@ex.org {far} ZARQUONIX, {prose(rng, 5)}") for i in range(4)]
    rows += [(600 + i, f"Quilby {prose(rng, 60)} ann@ex.org {prose(rng, 10)}") for i in range(4)]
    rows += [(700, f"{far} (Zarquonix) said"), (701, "Zarquonixes and Quilby. "), (702, "nothing")] + [(710, "Sorrel jim@ex.org " + "umber " * 3)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert all("zarquonix" not in clean[i].lower() and "[EMAIL]" in clean[i] for i in range(500, 504))
    assert all("Quilby" not in clean[i] for i in range(600, 604))
    assert clean[700] == f"{far} ([NAME]) said" and clean[701] == "Zarquonixes and [NAME]. " and clean[702] == "nothing"
    base, terms = pii.find_spans(df)
    found = {r["doc_id"]: [tuple(s) for s in r["terms"]] for r in base.join(terms, "key").collect()}
    text = dict(rows)
    assert found[700] == [(text[700].index("Zarquonix"), text[700].index("Zarquonix") + 9)] and 702 not in found


# ---------------------------------------------------------------- 9 and 10


def test_urls(spark):
    rows = [
        ("HTTP://A.Com:80/x?y#z", "a.com:80", "/x"), ("https://WWW.example.com/en/1", "www.example.com", "/en/1"), ("x://b.net/es/1#q", "b.net", "/es/1"),
        ("no scheme", "", ""), (None, "", ""), ("p://h?x", "h", ""), ("p:///q", "", "/q"), ("a://É.com/", "É.com", "/"),
    ]
    df = spark.createDataFrame([(i, r[0], None) for i, r in enumerate(rows)], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    out = {r["page_id"]: r for r in urls.judge(df, urls.RULES).collect()}
    assert [(out[i]["host"], out[i]["path"]) for i in range(len(rows))] == [r[1:] for r in rows]
    assert [out[i]["rule"] for i in range(4)] == [None, "www.example.com/en/", "net/es/", None] and out[2]["verdict"] == "block"
    assert urls.judge(df.where("false"), urls.RULES).count() == 0


def test_trust_equals_power_iteration(spark):
    rng = np.random.default_rng(12)
    n = 12
    a = (rng.random((n, n)) < 0.25) * rng.integers(1, 4, (n, n)) * (1 - np.eye(n, dtype=int))
    links = spark.createDataFrame([(f"h{i:02}", f"h{j:02}", int(a[i, j])) for i in range(n) for j in range(n) if a[i, j]], "src string, dst string, n long")
    seeds = spark.createDataFrame([("h00", 3, 0), ("h01", 1, 0), ("h02", 0, 2)], "host string, trust long, distrust long")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in urls.propagate(links, seeds, rounds=7).collect()}
    for k, (m, s) in enumerate(((a, [0.75, 0.25] + [0] * 10), (a.T, [0, 0, 1] + [0] * 9))):
        p = m / np.maximum(m.sum(axis=1, keepdims=True), 1)
        s = np.array(s, float)
        r = s
        for _ in range(7):
            r = 0.85 * r @ p + 0.15 * s
        assert np.allclose([got.get(f"h{i:02}", (0, 0))[k] for i in range(n)], r, atol=1e-9)


def test_links_block_those_who_link_to_the_blocked(spark):
    page = lambda i, url, *to: (i, url, "".join(f'<A class=x HREF="{t}">' for t in to))
    rows = [page(0, "http://bad.net/es/", "/x"), page(1, "http://fan.org/", "http://bad.net/es/1", "//bad.net/"), page(2, "http://good.com/", "https://liked.org/a"), page(3, "http://liked.org/"), page(4, "http://alone.org/")]
    out = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), urls.RULES).collect()}
    assert out == {0: "block", 1: "block", 2: "allow", 3: "allow", 4: "allow"}


def test_shards(spark, docs, none, texts):
    first = sharding.initial_map(spark, 16)
    grown = sharding.grow_map(first, 16)
    out = sharding.place(sharding.sized_rows(docs), first).collect()
    assert len(out) == docs.count()
    for s in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    for r in out:
        if r["doc_id"] is not None:
            raw = (texts[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    a, b = ({r["vslot"]: r["shard"] for r in m.collect()} for m in (first, grown))
    assert all(b[k] in (a[k], 16) for k in a) and 100 < sum(v == 16 for v in b.values()) < 400
    assert {r["vslot"]: r["shard"] for r in sharding.initial_map(spark, 17).collect()} == b
    assert sharding.place(sharding.sized_rows(none), first).count() == 0


def test_rebalancing_levels_bytes_and_moves_little(spark):
    rng = random.Random(13)
    first = sharding.initial_map(spark, 8, 512)
    sizes = spark.createDataFrame([(k, rng.randrange(1, 1000) * (3 if k % 8 == 1 else 1)) for k in range(512)], "vslot int, n_bytes long")
    new = sharding.rebalance_map(first, sizes, 8)
    loads = lambda m: [r[0] for r in m.join(sizes, "vslot").groupBy("shard").agg(F.sum("n_bytes")).select("sum(n_bytes)").collect()]
    before, after = loads(first), loads(new)
    assert max(after) - min(after) < 0.25 * (max(before) - min(before)) + 3000 and new.count() == 512
    assert first.join(new.withColumnRenamed("shard", "s2"), "vslot").where("shard <> s2").count() < 200


def test_distrust_far_off_is_kept_at_any_size(spark):
    links = [(f"h{i:02}", f"h{i + 1:02}", 1) for i in range(26)] + [(f"h{i:02}", f"x{i:02}", 49) for i in range(3, 6)]
    seeds = [("h26", 0, 1), ("else", 0, 10**9)]
    got = {r["host"]: r["distrust"] for r in urls.propagate(spark.createDataFrame(links, "src string, dst string, n long"), spark.createDataFrame(seeds, "host string, trust long, distrust long")).collect()}
    want = 0.15 / (1e9 + 1)
    for i in range(26, -1, -1):
        assert got[f"h{i:02}"] == pytest.approx(want, rel=1e-5), i
        want *= 0.85


def test_the_query_levels_the_bytes(spark, tmp_path):
    rng = random.Random(16)
    df = spark.createDataFrame([(i, "x" * int(rng.paretovariate(1.2) * 20)) for i in range(3000)], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = sharding.op10_slots(spark, str(tmp_path)).toPandas()
    grown, level = (out.groupby(c)["size"].sum() for c in ("grown_shard", "level_shard"))
    assert len(out) == 3000 and level.max() < grown.max() and level.std() < 0.5 * grown.std()
    assert out.groupby("shard")["slot"].apply(lambda s: sorted(s) == list(range(len(s)))).all()


# ---------------------------------------------------------------- 11


GERMAN = "der die das und ist nicht ein eine mit von zu auf sich auch werden haben über können müssen wieder noch schon jetzt".split()


def german(rng, n):
    return " ".join(rng.choice(GERMAN) + rng.choice(["", "en", "er", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(21)
    rows = [(i, prose(rng, 60) if i % 3 else german(rng, 60), "en" if i % 3 else "de") for i in range(150)]
    rows += [(900, None, "en"), (901, "nameless", None), (None, "no id at all", "xx"), (5, rows[5][1], rows[5][2])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"nearest": F.lit("clash"), "score": F.lit("clash"), "row": F.lit(1), "said": F.lit(1), "word": F.lit("x"), "place": F.lit(0), "hash": F.lit(0)})


def test_languages_are_told_apart(spark, spoken):
    said = langid.train(spoken)
    assert list(said) == ["en", "de"]  # the one with more texts first; rows without an id don't teach
    model, rng = langid.Model(said), random.Random(22)
    for k in range(30):
        assert model.answer(prose(rng, 30).upper() + " 12 !!")[0] == "en" and model.answer(german(rng, 30))[0] == "de"
    long = " ".join([german(rng, 3000), prose(rng, 500)])
    assert model.answer(long)[0] == "de" and model.answer(prose(rng, 500) + " " + german(rng, 3000))[0] == "de"  # whole texts count
    for text in (None, "", " \n", "12 34!", "\u00b2\u2460 \u00bd"):
        assert model.answer(text) == ("und", 0.0, True)


def test_equal_sizes_go_to_the_commoner_language_and_are_rejected(spoken):
    model = langid.Model(langid.train(spoken))
    assert model.answer("q") == ("en", 0.5, True)
    kept = {r["doc_id"] for r in langid.keep_languages(spoken, langid.train(spoken), ["de"]).collect()}
    assert kept == {i for i in range(0, 150, 3)}
    assert langid.keep_languages(spoken, langid.train(spoken), ["de"]).columns == spoken.columns


def test_pieces_cover_the_text_and_letters_are_composed():
    model = langid.Model({"a": b"        abc abd ", "b": b"        xyz "})
    text = "abc abd " * 3000
    raw = langid.letters(text).encode()
    assert model.sizes(text)[0] == sum(len(model.compress[0](raw[i : i + langid.PIECE])) for i in range(0, len(raw), langid.PIECE))
    assert langid.letters("E\u0301te\u0301 99") == "\u00e9t\u00e9" and langid.letters("\u4e2d\u6587") == "\u4e2d\u6587"


def test_nothing_or_one_language_to_learn_from(spark, spoken):
    assert langid.train(spoken.where("false")) == {} and langid.Model({}).answer("words") == ("und", 0.0, True)
    one = langid.train(spoken.where("lang = 'de'"))
    assert langid.Model(one).answer("any words") == ("de", 1.0, False)
    few = langid.training_rows(spoken, langid.text_counts(spoken), 7)
    assert {(r["lang"], r["count"]) for r in few.groupBy("lang").count().collect()} == {("de", 7), ("en", 7)}
    assert spoken.select(langid.identify(spoken, {}).alias("s")).where("s.nearest <> 'und'").count() == 0


def test_held_out_rows_do_not_teach(spark, spoken):
    moved = spoken.withColumn("lang", F.when(langid.fold(F.col("doc_id")) == 2, "zz").otherwise(F.col("lang")))
    assert langid.train(moved) == langid.train(spoken)


# ---------------------------------------------------------------- 12


@pytest.mark.parametrize("d", [1, 2, 3, 8, 33])
def test_rotations_equal_a_library(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, d))
    a = a @ a.T
    e, v = whiten.jacobi(a)
    assert np.allclose(e, np.linalg.eigvalsh(a)[::-1]) and np.allclose(v.T @ v, np.eye(d)) and np.allclose(v * e @ v.T, a)


def test_small_eigenvalues_keep_their_digits():
    scale = 10.0 ** -np.arange(8)
    core = 0.9 * np.eye(8) + 0.1
    e, _ = whiten.jacobi(scale[:, None] * core * scale)
    # the determinant is 0.9^7 (0.9 + 0.8) times the squared scales
    assert abs(np.prod(e * 10.0 ** (2 * np.arange(8))) / (0.9**7 * 1.7) - 1) < 1e-9
    assert whiten.jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<float>").withColumns({"x": F.lit("clash"), "c": F.lit("clash"), "d": F.lit(1), "y": F.lit(1)})


def test_whitened_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5)) + 7
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(x)]
    bad = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0]), (902, [float("nan")] * 5), (903, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (904, []), (905, [1.0, 2.0])]
    extra = [(None, rows[0][1]), (3, rows[3][1])]
    whole = whiten.whole_vectors(vectors_of(spark, rows + bad + extra))
    model = whiten.fit(whole)
    assert model.n == 202 and len(model.e) == 5
    out = whiten.whiten(whole, model).collect()
    y = np.array([r["y"] for r in out])
    assert len(out) == 202 and np.abs(y.T @ y / 202 - np.eye(5)).max() < 1e-9 and whiten.identity_error(whole, model) < 1e-9
    big = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows + extra]
    sums = [sum(c) for c in zip(*big)]
    assert sorted(r["deviation"] for r in out) == sorted(sum((202 * a - s) ** 2 for a, s in zip(v, sums)) for v in big)


def test_axes_without_variance_and_nothing(spark):
    flat = whiten.whole_vectors(vectors_of(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(10)]))
    assert len(whiten.fit(flat).e) == 1
    same = whiten.whole_vectors(vectors_of(spark, [(i, [1.0, 2.0]) for i in range(4)]))
    assert len(whiten.fit(same).e) == 0
    assert whiten.fit(whiten.whole_vectors(vectors_of(spark, [(1, None)]))) is None
    huge = whiten.whole_vectors(vectors_of(spark, [(0, [3e38, 0.0]), (1, [-3e38, 1.0]), (2, [0.0, 5.0])]))
    model = whiten.fit(huge)
    assert model.n == 3 and None in [r["deviation"] for r in whiten.whiten(huge, model).collect()]  # beyond a long


# ---------------------------------------------------------------- 13


def conversation_rows(spark, convs):
    rows = [(c, None if d == 0 else d, *turn) for c, turns in convs.items() for d, turn in enumerate(turns)]
    clash = {n: F.lit("clash") for n in ("place", "k1", "h1", "n", "depth", "path", "block", "at", "part")}
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(clash)


def nodes_of(turns, sizes):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if r[c] is None else r[c] for c in names) for r in trie.prefix_trie(turns, sizes).collect())


@pytest.mark.parametrize("hot,block", [(10_000, 4096), (2, 3)])
def test_trees_equal_plain_prefixes(spark, monkeypatch, hot, block):
    from test_queries import trie as plain

    monkeypatch.setattr(trie, "HOT", hot)
    monkeypatch.setattr(trie.running, "__defaults__", (block,))
    monkeypatch.setattr(trie, "CHUNK", 2)
    rng = random.Random(31)
    convs = {}
    for c in range(-20, 60):
        n = rng.randrange(0, 9) if c else 40
        convs[c] = [("user" if d % 2 == 0 else "bot", rng.choice(["a", "bb", "", "É漢"]) if d else "hello") for d in range(n)]
    convs[60] = convs[59] = convs[0][:]  # copies of the longest
    rows = conversation_rows(spark, convs)
    turns, sizes = trie.ordered_turns(rows)
    known = {c: [(r or "", t or "") for r, t in ts] for c, ts in convs.items() if ts}
    assert nodes_of(turns.withColumnRenamed("place", "depth"), sizes.withColumnRenamed("n", "total")) == plain(known)


def test_shared_openings_and_turnless_conversations(spark):
    from test_queries import rebuilt, trie as plain

    rng = random.Random(32)
    rows = [(c, d, rng.choice(["user", None]), rng.choice(["x", "yy", None])) for c in [*range(100, 140), 205, 7, -103, -100] for d in range(rng.randrange(1, 8))]
    rows += [(None, 1, "user", "lost"), (101, None, "user", "first"), (102, 0, "a", "tie"), (102, 0, "a", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = nodes_of(*trie.share_openings(*trie.ordered_turns(df)))
    plain_rows = rebuilt([r for r in rows if r[0] is not None and r[0] >= 0])
    only = nodes_of(*trie.share_openings(*trie.ordered_turns(df.where("conv_id >= 0"))))
    assert only == plain(plain_rows) and got[0][0] == -103
    assert nodes_of(*trie.share_openings(*trie.ordered_turns(df.where("false")))) == []


def test_only_turnless_conversations_are_one_root(spark):
    sizes = spark.createDataFrame([(4, 0), (3, 0)], "conv_id long, total long")
    turns = spark.createDataFrame([], "conv_id long, depth long, h1 long, h2 long, chars long")
    assert nodes_of(turns, sizes) == [(3, 0, -1, 2, 0, 1, 0, hashlib.sha256(b"3,4").hexdigest())]


# ---------------------------------------------------------------- columns that have the operators' own names

OWN = ["pii_email", "pii_ip", "pii_card", "pii_phone", "pii_base", "pii_key", "pii_terms", "pii_text", "row", "said", "told", "score", "_bpe", "_toxic", "body", "at", "out", "hits", "base", "spans"]


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(41)
    rows = [(i, prose(rng, 30) + f" Jane Roe a{i}@b.org 10.0.0.{i} +1 (555) 010-99{i:02d} paid 4111 1111 1111 1111") for i in range(8)]
    rows += [(20, None), (21, ""), (22, prose(rng, 120_000) + " z@y.org")]  # one very long text
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(f"own {c}") for c in OWN})


def same_columns(before, after, but=("text",)):
    assert [c for c in after.columns if c not in but] == [c for c in before.columns if c not in but]
    for r in after.collect():
        assert all(r[c] == f"own {c}" for c in OWN)
    assert after.count() == before.count()


def test_sanitise_keeps_columns_of_any_name(clashing):
    out = pii.sanitise(clashing)
    same_columns(clashing, out)
    shown = {r["doc_id"]: r["text"] for r in out.select("doc_id", "text").collect()}
    assert shown[20] is None and shown[21] == "" and all(f"[{k}]" in shown[3] for k in ("EMAIL", "IP", "CARD", "PHONE")) and shown[22].endswith("[EMAIL]")


def test_tokens_and_scores_keep_columns_of_any_name(spark, clashing):
    path = public_tokenizers.path("word_bpe_49k.json")
    twice = clashing.withColumns({"n_tokens": F.lit("old"), "ids": F.lit("old")})
    out = bpe.round_trip(twice, path, keep_ids=True)
    assert out.columns == ["doc_id", *OWN, "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    lib = library_tokens(path)
    for r in out.collect():
        text = next(t for i, t in clashing.select("doc_id", "text").collect() if i == r["doc_id"]) or ""
        assert r["ids"] == lib.encode(text, add_special_tokens=False).ids and r["row"] == "own row" and r["n_tokens"] == len(r["ids"])
    assert bpe.round_trip(clashing.select("text"), path).columns == ["n_tokens", "ids_sha256", "decoded_sha256"]
    net = toxicity.fit(["bad awful words"] * 4 + ["good plain words"] * 4, [1] * 4 + [0] * 4, rounds=1)
    same_columns(clashing, toxicity.drop_toxic(clashing, net, cutoff=1.1), but=())
    assert toxicity.drop_toxic(clashing, None).count() == clashing.count()


def library_tokens(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_media_replaces_columns_of_its_names(clashing):
    short = clashing.where("doc_id < 3").withColumns({"media": F.lit("old"), "tensor": F.lit("old")})
    out = media.decode_media(media.store_payload(short))
    assert out.columns == short.columns
    for r in out.collect():
        assert r["tensor"]["height"] > 0 and r["said"] == "own said" and bytes(r["media"])[:2] == b"\xff\xd8"
