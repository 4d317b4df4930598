"""The pipeline, stage by stage, against brute force on the smallest tables."""

import random
import re

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from motionmill.llm import decontaminate as dec, pii, toxicity
from motionmill.llm._shared import written

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage returned, in order, the documents first."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, written(stage(spark, out[-1][1], DIR), name)))
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns(kept):
    assert all(df.columns == kept[0][1].columns for _, df in kept[:-1])


def test_toxic_documents_go(spark, kept):
    net = toxicity.train(kept[0][1], spark.read.parquet(f"{DIR}/labels.parquet"))
    before = texts(kept[0][1])
    scores = dict(zip(before, toxicity.Scorer(net).score(list(before.values())))) if net else dict.fromkeys(before, 0.0)
    assert ids(kept[1][1]) == sorted(i for i, s in scores.items() if s < toxicity.CUTOFF)


def test_one_of_each_group_of_near_copies_stays(kept):
    prints = {}
    for i, t in texts(kept[1][1]).items():
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in prints}
    for _ in prints:
        new = {i: min(root[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 2) for i in prints}
        if new == root:
            break
        root = new
    assert ids(kept[2][1]) == sorted(set(root.values()))


def test_contaminated_documents_go(spark, kept):
    items = [dec.words_of(r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    gone = set(ids(kept[2][1])) - set(ids(kept[3][1]))
    for i, t in texts(kept[2][1]).items():
        w = dec.words_of(t)
        close = any(len(x) >= dec.MIN_WORDS and dec.best_match(x, w)[0] <= int(dec.EDITS * len(x)) for x in items)
        assert close == (i in gone), i


def test_no_personal_data_is_left(kept):
    before, after = texts(kept[3][1]), texts(kept[4][1])
    assert set(before) == set(after)
    left = pii.with_base_spans(kept[4][1]).where(F.size("pii_base") > 0).count()
    found = {r["doc_id"]: r["base"] for r in pii.find_spans(kept[3][1])[0].collect()}
    assert left == 0 and any(found.values())
    for i, t in after.items():
        assert (t == before[i]) == (not found[i])
    assert all(r["n_chars"] == len(r["text"]) for r in kept[4][1].collect())


def test_ids_are_the_library_s(kept):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, r in {r["doc_id"]: r for r in kept[5][1].collect()}.items():
        assert r["ids"] == library.encode(texts_of(kept)[i], add_special_tokens=False).ids


_TEXTS = {}


def texts_of(kept):
    if not _TEXTS:
        _TEXTS.update(texts(kept[4][1]))
    return _TEXTS


def test_stages_take_nulls_and_empty_tables(spark, kept):
    rng = random.Random(0)
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, " ".join(rng.choice(["ab", "cd", "e"]) for _ in range(3000)), "en", None, 1)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, DIR), "odd")
        assert docs.count() <= 3


def test_run_gives_the_last_stage(spark, kept):
    assert ids(entry.queries()["pipeline"](spark, DIR)) == ids(kept[-1][1])


def test_stages_keep_columns_of_any_name_and_long_texts(spark, monkeypatch):
    """Nulls, a text of over 100,000 words and columns with the operators' own names go through all stages whole.

    No label is learned, since random letters are like nothing that the network has seen.
    """
    monkeypatch.setattr(toxicity, "train", lambda *_: None)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(4000)]
    rows = [(10**9 + i, " ".join(rng.choice(words) for _ in range(n)), "en", "s", 0) for i, n in enumerate([120_000, 40, 60, 80])]
    rows += [(10**9 + 50, None, None, None, None)]
    own = {c: F.lit(f"own {c}") for c in ("pii_ip", "pii_base", "pii_key", "row", "said", "told", "score", "fp", "_bpe", "_toxic", "ids", "n_tokens", "key", "item_id")}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(own)
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, DIR), name)
        assert docs.columns == before.columns, name
    left = {r["doc_id"]: r for r in docs.collect()}
    assert set(left) == {r[0] for r in rows} and all(r[c] == f"own {c}" for r in left.values() for c in own)
    assert left[10**9]["text"] == rows[0][1]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DIR).count() == len(rows)
