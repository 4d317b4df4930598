"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is the sum of its own vector, for words seen often enough in training, and the mean of the vectors of
its character n-grams, with word edges. Overlapping windows of ``SPAN`` words, ``STEP`` apart, cover the whole text; a
GRU reads each from both sides, attention pools its states into one logit, and the text's score is the sigmoid of its
highest window's. Training alternates two steps: score all windows of the training texts, then fit the weights on the
highest window of each.

Training takes the labelled texts of fold 0, 1 and 3 (crc32 of the id as text, modulo 4), at most ``SAMPLE`` of them,
the least by a hash of the id. Nothing but the text enters a score. Null texts and texts without words are one window
of padding. Rows with a null label or id do not train; of rows that repeat an id the least text trains, with the largest
label; all rows are scored, equal texts alike. Without any usable label every score is 0. Other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from motionmill.llm._shared import kept, small_batches, table

SAMPLE = 8000
SPAN, STEP = 32, 16
HIDDEN, EMBED = 8, 8
GRAM_BUCKETS = 1 << 15
WORDS = 20_000
CUTOFF = 0.3
FOLDS, HELD_OUT = 4, 2
#: Words whose inputs a worker keeps.
CACHE_WORDS = 60_000
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def gram_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all 3-, 4- and 5-grams of ``^word$``, word after word, and how many each word has."""
    text = "".join(f"^{w}$" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    ids, owners = [], []
    h = codes.copy()
    for n in range(2, 6):
        h = h[:-1] * np.uint64(1_000_003) + codes[n - 1 :] if h.size > 1 else h[:0]
        if n > 2:
            same = owner[: h.size] == owner[n - 1 : n - 1 + h.size]
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            ids.append((mixed >> np.uint64(40)).astype(np.int64)[same] % GRAM_BUCKETS)
            owners.append(owner[: h.size][same])
    order = np.argsort(np.concatenate(owners), kind="stable")
    return np.concatenate(ids)[order].astype(np.int32), np.bincount(np.concatenate(owners), minlength=len(words))


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of ``sizes`` words laid end to end: text, first place and length of every window."""
    n = np.maximum(np.ceil((sizes - SPAN) / STEP).astype(np.int64), 0) + 1
    text = np.repeat(np.arange(sizes.size), n)
    inner = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STEP
    return text, np.repeat(np.cumsum(sizes) - sizes, n) + inner, np.minimum(sizes[text] - inner, SPAN)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Weights: word and gram vectors, input projection W, b; recurrent U; attention a; output c, d. Direction is the first axis."""

    def __init__(self, vocab: dict[str, int], seed: int = 7):
        rng = np.random.default_rng(seed)
        near = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        self.vocab = vocab
        self.p = {
            "word": near(len(vocab) + 1, EMBED), "gram": near(GRAM_BUCKETS, EMBED), "W": near(2, EMBED, 3 * HIDDEN) * 5,
            "b": np.zeros((2, 1, 3 * HIDDEN), np.float32), "U": near(2, HIDDEN, 3 * HIDDEN) * 2, "a": near(2 * HIDDEN),
            "c": near(2 * HIDDEN) * 5, "d": np.full(1, -2, np.float32),
        }
        self.p["word"][0] = 0

    def vectors(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        ids, n = gram_ids(words)
        own = np.array([self.vocab.get(w, 0) for w in words])
        starts = np.cumsum(n) - n
        return self.p["word"][own] + np.add.reduceat(self.p["gram"][ids], starts, axis=0) / n[:, None].astype(np.float32), (own, ids, n)

    def inputs(self, vectors: np.ndarray) -> np.ndarray:
        """(words, 2, 3H), with a last row of zeros for padding."""
        x = np.matmul(vectors[None], self.p["W"]) + self.p["b"]
        return np.concatenate((x.transpose(1, 0, 2), np.zeros((1, 2, 3 * HIDDEN), np.float32)))

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, ...]:
        """x: (SPAN, 2, N, 3H), the second direction already reversed; mask: (SPAN, 2, N, 1). Returns logits and what backward needs."""
        h = np.zeros((2, x.shape[2], HIDDEN), np.float32)
        states = np.empty((SPAN, 2, x.shape[2], HIDDEN), np.float32)
        for t in range(SPAN):
            g = np.matmul(h, self.p["U"])
            zr = _sigmoid(x[t, :, :, : 2 * HIDDEN] + g[:, :, : 2 * HIDDEN])
            z, r = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:]
            un = g[:, :, 2 * HIDDEN :]
            new = np.tanh(x[t, :, :, 2 * HIDDEN :] + r * un)
            if keep is not None:
                keep.append((h, z, r, new, un))
            h = h + mask[t] * (1 - z) * (new - h)
            states[t] = h
        both = np.concatenate((states[:, 0], states[::-1, 1]), axis=2)  # (SPAN, N, 2H)
        score = both @ self.p["a"] + (mask[:, 0, :, 0] - 1) * 1e4
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, both)
        return pooled @ self.p["c"] + self.p["d"], both, weight, pooled

    def backward(self, x, mask, keep, both, weight, pooled, dlogit) -> tuple[dict, np.ndarray]:
        g = {"c": pooled.T @ dlogit, "d": np.array([dlogit.sum()], np.float32)}
        dpool = dlogit[:, None] * self.p["c"]
        dweight = np.einsum("nh,tnh->tn", dpool, both)
        dscore = weight * (dweight - (weight * dweight).sum(axis=0))
        g["a"] = np.einsum("tn,tnh->h", dscore, both)
        dboth = weight[:, :, None] * dpool + dscore[:, :, None] * self.p["a"]
        dstate = np.stack((dboth[:, :, :HIDDEN], dboth[::-1, :, HIDDEN:]), axis=1)
        dx, dU = np.zeros_like(x), np.zeros_like(self.p["U"])
        carry = np.zeros_like(dstate[0])
        for t in range(SPAN - 1, -1, -1):
            h, z, r, new, un = keep[t]
            dh = dstate[t] + carry
            dm = dh * mask[t]
            dnew = dm * (1 - z) * (1 - new * new)
            dz = dm * (h - new) * z * (1 - z)
            dr = dnew * un * r * (1 - r)
            dx[t] = np.concatenate((dz, dr, dnew), axis=2)
            dg = np.concatenate((dz, dr, dnew * r), axis=2)
            dU += np.matmul(h.transpose(0, 2, 1), dg)
            carry = dh - dm * (1 - z) + np.matmul(dg, self.p["U"].transpose(0, 2, 1))
        g["U"] = dU
        return g, dx

    def gather(self, x: np.ndarray, places: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs and masks of windows over ``places`` (rows of ``x`` by word), both directions, and the rows used."""
        at = np.arange(SPAN)[:, None]
        inside = at < size
        rows = places[np.minimum(first + at, places.size - 1)] if places.size else np.zeros(inside.shape, np.int64)
        return self.lay_out(x, np.where(inside, rows, x.shape[0] - 1), inside)

    def lay_out(self, x: np.ndarray, rows: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        both = np.stack((rows, rows[::-1]), axis=1)  # (SPAN, 2, N)
        mask = np.stack((inside, inside[::-1]), axis=1)[..., None].astype(np.float32)
        return x[both, np.arange(2)[:, None]], mask, both

    def logits(self, x: np.ndarray, places: np.ndarray, sizes: np.ndarray, width: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Highest window logit of each text, and that window's number."""
        text, first, size = windows(sizes)
        out = np.empty(text.size, np.float32)
        for i in range(0, text.size, width):
            xs, mask, _ = self.gather(x, places, first[i : i + width], size[i : i + width])
            out[i : i + width] = self.forward(xs, mask)[0]
        order = np.lexsort((-out, text))
        top = order[np.concatenate(([True], np.diff(text[order]) > 0))]
        return out[top], top


def fit(texts: list[str], labels: list[int], rounds: int = 8, batch: int = 256, rate: float = 0.01, seed: int = 7) -> Network:
    """Trains on whole texts; grams and words start from how much oftener toxic texts hold them."""
    y = np.array(labels, np.float32)
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int32) for t in texts]
    held = [np.unique(d) for d in docs]
    distinct = list(number)
    seen = np.bincount(np.concatenate([*held, np.empty(0, np.int32)]), minlength=len(distinct))
    vocab = {distinct[w]: i + 1 for i, w in enumerate(np.argsort(-seen, kind="stable")[:WORDS].tolist()) if seen[w] >= 3}
    net = Network(vocab, seed)
    rng = np.random.default_rng(seed)
    if not distinct or not 0 < y.sum() < y.size:
        return net
    some = [gram_ids(distinct[i : i + 10_000]) for i in range(0, len(distinct), 10_000)]
    ids, n = (np.concatenate(x) for x in zip(*some))
    starts = np.cumsum(n) - n
    places = np.concatenate(docs)
    sizes = np.array([len(d) for d in docs], np.int64)
    _, first, size = windows(sizes)
    own = np.array([vocab.get(w, 0) for w in distinct])

    def odds(kinds_of, length: int) -> np.ndarray:
        count = np.zeros((2, length))
        for words, label in zip(held, labels):
            count[int(label), kinds_of(words)] += 1
        share = (count + 0.5) / (np.array([[y.size - y.sum()], [y.sum()]]) + 1)
        return np.clip(np.log(share[1] / share[0]), -2, 3).astype(np.float32)

    def spread(words: np.ndarray) -> np.ndarray:
        """Places in ``ids`` of all grams of ``words``."""
        return np.repeat(starts[words] - (np.cumsum(n[words]) - n[words]), n[words]) + np.arange(n[words].sum())

    def vectors(words: np.ndarray) -> np.ndarray:
        inner = np.cumsum(n[words]) - n[words]
        return net.p["word"][own[words]] + np.add.reduceat(net.p["gram"][ids[spread(words)]], inner, axis=0) / n[words, None].astype(np.float32)

    def highest() -> np.ndarray:
        """The highest window of each text, a few texts at a time."""
        out, seen_windows = [], 0
        for part in np.array_split(np.arange(sizes.size), sizes.size // 500 + 1):
            words = np.concatenate([docs[i] for i in part])
            mine, local = np.unique(words, return_inverse=True)
            x = net.inputs(vectors(mine)) if mine.size else np.zeros((1, 2, 3 * HIDDEN), np.float32)
            out.append(net.logits(x, local, sizes[part])[1] + seen_windows)
            seen_windows += len(windows(sizes[part])[0])
        return np.concatenate(out)

    net.p["word"][:, 0] = 0.5 * odds(lambda w: np.unique(own[w]), len(vocab) + 1)
    net.p["word"][0] = 0
    net.p["gram"][:, 0] = odds(lambda w: np.unique(ids[spread(w)]), GRAM_BUCKETS)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    for k in range(rounds):
        top = highest()
        for _ in range(2):
            for part in np.array_split(rng.permutation(y.size), max(y.size // batch, 1)):
                used = top[part]
                at = first[used] + np.arange(SPAN)[:, None]
                inside = np.arange(SPAN)[:, None] < size[used]
                mine = np.unique(places[at[inside]])
                local = np.searchsorted(mine, places[np.minimum(at, places.size - 1)])
                v = vectors(mine)
                x, mask, rows = net.lay_out(net.inputs(v), np.where(inside, local, mine.size), inside)
                keep: list = []
                logit, both, weight, pooled = net.forward(x, mask, keep)
                dlogit = ((_sigmoid(logit) - y[part]) / part.size).astype(np.float32)
                g, dx = net.backward(x, mask, keep, both, weight, pooled, dlogit)
                flat = np.zeros((2, mine.size + 1, 3 * HIDDEN), np.float32)
                for side in range(2):
                    np.add.at(flat[side], rows[:, side].ravel(), dx[:, side].reshape(-1, 3 * HIDDEN))
                flat = flat[:, :-1]
                g["W"] = np.matmul(v.T[None], flat)
                g["b"] = flat.sum(axis=1, keepdims=True)
                dv = np.einsum("swg,seg->we", flat, net.p["W"])
                g["word"] = np.zeros_like(net.p["word"])
                np.add.at(g["word"], own[mine], dv)
                g["word"][0] = 0
                g["gram"] = np.zeros_like(net.p["gram"])
                np.add.at(g["gram"], ids[spread(mine)], np.repeat(dv / n[mine, None], n[mine], axis=0).astype(np.float32))
                step += 1
                for name, grad in g.items():
                    m, s = moment[name]
                    m += 0.1 * (grad - m)
                    s += 0.001 * (grad * grad - s)
                    size_now = rate * (0.5 if k > rounds // 2 else 1) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    net.p[name] -= (size_now * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
    return net


class Scorer:
    """Scores texts with a trained network; inputs of words met are kept, up to ``CACHE_WORDS``."""

    def __init__(self, net: Network):
        self.net, self.known = net, {}
        self.x = np.empty((0, 2, 3 * HIDDEN), np.float32)

    def score(self, texts: list[str]) -> np.ndarray:
        docs = [words_of(t) for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known, self.x = {}, self.x[:0]
        new = sorted({w for d in docs for w in d if w not in self.known})
        if new:
            base = len(self.known)
            self.known.update({w: base + i for i, w in enumerate(new)})
            self.x = np.concatenate((self.x[:base], self.net.inputs(self.net.vectors(new)[0])))
        x = self.x if self.x.size else np.zeros((1, 2, 3 * HIDDEN), np.float32)
        places = np.fromiter((p for d in docs for p in map(self.known.__getitem__, d)), np.int64)
        sizes = np.array([len(d) for d in docs], np.int64)
        return _sigmoid(self.net.logits(x, places, sizes)[0].astype(np.float64)) if len(docs) else np.empty(0)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def training_rows(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic): at most ``sample`` labelled texts outside the held-out fold."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    picked = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    met = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    return met.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    """The network fitted on the bounded sample, in one task; only its weights reach the driver. None without both labels."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True).sort_values("doc_id")
        if rows["toxic"].nunique() == 2:
            labels, texts = rows["toxic"].astype(int).tolist(), rows.pop("text").tolist()
            yield pd.DataFrame({"model": [pickle.dumps(fit(texts, labels))]})

    got = training_rows(documents, labels, sample).repartition(1).mapInPandas(run, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else None


def score_texts(df: DataFrame, net: Network | None, text: str = "text") -> Column:
    """The score of each whole text."""
    small_batches(df.sparkSession)
    if net is None:
        return F.lit(0.0)
    sent, token = df.sparkSession.sparkContext.broadcast(net), uuid.uuid4().hex

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = kept(f"toxicity {token}", lambda: Scorer(sent.value))
        for texts in batches:
            yield pd.Series(scorer.score(texts.tolist()))

    return score(F.col(text))


def drop_toxic(df: DataFrame, net: Network | None, text: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """``df`` without the rows that score ``cutoff`` or more; all columns, whatever their names, as they were."""
    return df.select(F.struct("*").alias("row"), score_texts(df, net, text).alias("score")).where(F.col("score") < cutoff).select("row.*")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    net = train(documents, table(spark, sf_dir, "labels"))
    scored = documents.select("doc_id", score_texts(documents, net).alias("score"))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
