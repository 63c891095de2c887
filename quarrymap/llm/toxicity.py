"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its hashed character n-grams (and itself); its vector is
their mean, a text's vector the mean of its words' vectors, and two softmax
weights sit on top. Vectors and weights are trained jointly in numpy, so a
misspelling that was never seen still shares most of its vectors with the word
it comes from. Every bucket has a vector, however rare it is: steps are scaled
by what a bucket has seen, and a small pull to zero (``l1``, on whole vectors)
leaves those that say nothing at zero. The softmax is linear, so after training
every word is one number and scoring a text is a sum over its words: one pass,
no shuffle.

Only the sample that is learnt from is bounded (``max_train_docs`` labelled
documents). Executors turn its texts into averaged bags, at most ``buckets``
numbers each, so what reaches the driver has a bound, however long a text is.

Defined results: a null or empty text, or one without words, has the score of
the bias alone; repeated rows are scored each, and of the texts of one doc_id the
least counts in training; with no usable labels every score is the prior 0; an
empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, column_of, held_out, labelled, map_columns, release


@dataclass(frozen=True)
class ToxicityParams:
    #: Labelled documents learnt from at most, half of each label (the documented bound of the sample).
    max_train_docs: int = 4000
    buckets: int = 1 << 18
    dim: int = 8
    #: n-grams are of UTF-8 bytes, edge marks included.
    min_n: int = 4
    max_n: int = 6
    #: Batches of so many documents that are learnt from, whatever the sample's size.
    steps: int = 1000
    batch_docs: int = 64
    learning_rate: float = 0.5
    softmax_rate: float = 0.05
    #: Pull of every vector to zero, for each document that has its bucket.
    l1: float = 2e-5
    #: The averaged vector is scaled by this, as toxic words are few in a text.
    scale: float = 60.0
    #: Added to a text's number of words in the mean, so that a few words can't say much.
    padding: int = 5
    threshold: float = 0.7
    seed: int = 7


_EDGE = b".,;:!?\"'()[]{}"


def word_of(token: bytes) -> bytes:
    """The lower-cased word of a token, without punctuation around it."""
    return token.strip(_EDGE) or token


def subwords(words: list[bytes], p: ToxicityParams) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word number) of every subword of every word, itself included: UTF-8 n-grams between edge marks, hashed all at once."""
    marked = [b"<" + w + b">" for w in words]
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    end = np.repeat(np.cumsum(size), size)
    owner = np.repeat(np.arange(len(marked)), size)
    buckets = [np.fromiter((zlib.crc32(m) % p.buckets for m in marked), np.int64, len(marked))]
    owners = [np.arange(len(marked))]
    for n in range(p.min_n, p.max_n + 1):
        m = max(0, len(data) - n + 1)
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + data[j : j + m]
        inside = np.arange(m) + n <= end[:m]
        buckets.append(((h[inside] >> np.uint64(20)) % np.uint64(p.buckets)).astype(np.int64))
        owners.append(owner[:m][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def tokens(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().split()


def bag(text: bytes) -> tuple[list[bytes], list[int]]:
    """Distinct words of a text, in order of first appearance, and their counts."""
    counts = Counter(map(word_of, tokens(text)))
    return list(counts), list(counts.values())


@dataclass
class ToxicityModel:
    #: What one occurrence of each bucket adds to the log-odds, before averaging.
    bucket_odds: np.ndarray
    bias: float
    params: ToxicityParams

    def word_odds(self, words: list[bytes]) -> np.ndarray:
        """The mean of each word's subwords."""
        buckets, owner = subwords(words, self.params)
        n = len(words)
        return np.bincount(owner, self.bucket_odds[buckets], n) / np.maximum(1, np.bincount(owner, minlength=n))

    def scores(self, texts: list[bytes], cache: dict[bytes, float], limit: int = 150_000) -> np.ndarray:
        """Scores of whole texts; ``cache`` keeps the log-odds of tokens and is cleared when it grows too large."""
        out = np.empty(len(texts))
        look = cache.__getitem__
        for at in range(0, len(texts), 256):
            split = [tokens(t) for t in texts[at : at + 256]]
            if len(cache) > limit:
                cache.clear()
            new = [w for w in set().union(*split) if w not in cache]
            if new:
                cache.update(zip(new, self.word_odds([word_of(w) for w in new]).tolist()))
            for i, words in enumerate(split, at):
                mean = sum(map(look, words)) / (len(words) + self.params.padding)
                out[i] = 1 / (1 + math.exp(-max(-60.0, min(60.0, self.bias + mean))))
        return out


def averaged(text: bytes, p: ToxicityParams) -> tuple[np.ndarray, np.ndarray]:
    """A text as the mean of its words' bags: (buckets, shares), each bucket once."""
    words, counts = bag(text)
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    buckets, owner = subwords(words, p)
    counts = np.array(counts, float)
    share = (counts / np.bincount(owner, minlength=len(words)) / (counts.sum() + p.padding))[owner]
    own, where = np.unique(buckets, return_inverse=True)
    return own.astype(np.int32), np.bincount(where, share).astype(np.float32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, prior: float, p: ToxicityParams) -> ToxicityModel:
    """Fit bucket vectors and softmax weights on averaged bags (buckets, shares).

    ``prior`` is the share of label 1 among all usable labels: the sample is
    balanced, so the classes are weighted back to it. The odds after each epoch of
    the second half are averaged.
    """
    empty = ToxicityModel(np.zeros(p.buckets, np.float32), -60.0, p)
    n = len(bags)
    if n == 0 or not 0 < y.sum() < n:
        return empty if n == 0 or y.sum() == 0 else ToxicityModel(empty.bucket_odds, 60.0, p)
    mark = np.zeros(p.buckets, bool)
    for own, _ in bags:
        mark[own] = True
    live = np.flatnonzero(mark)
    place = np.zeros(p.buckets, np.int32)
    place[live] = np.arange(len(live), dtype=np.int32)
    columns, shares = [place[own] for own, _ in bags], [share * np.float32(p.scale) for _, share in bags]
    rng = np.random.default_rng(p.seed)
    soft = rng.normal(0, 1, (p.dim, 2)).astype(np.float32)
    soft /= np.linalg.norm(soft[:, 1] - soft[:, 0])
    vectors, bias = np.zeros((len(live), p.dim), np.float32), np.zeros(2, np.float32)
    seen = np.full(len(live), 1e-8, np.float32)  # squared gradients of each vector so far
    share = y.mean()
    cost = np.where(y == 1, prior / share, (1 - prior) / (1 - share)).astype(np.float32)
    mark, place, odds, level, averaged_over = np.zeros(len(live), bool), np.zeros(len(live), np.int32), np.zeros(len(live)), 0.0, 0
    room = np.empty(0, np.float32)
    epochs = -(-p.steps // -(-n // p.batch_docs))
    for epoch in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, p.batch_docs):
            own = order[at : at + p.batch_docs]
            every = np.concatenate([columns[i] for i in own])
            mark[every] = True
            used = np.flatnonzero(mark)
            mark[used] = False
            place[used] = np.arange(len(used), dtype=np.int32)
            if len(room) < len(own) * len(used):
                room = np.empty(2 * len(own) * len(used), np.float32)
            mean = room[: len(own) * len(used)].reshape(len(own), len(used))
            mean[:] = 0
            mean[np.repeat(np.arange(len(own)), [len(columns[i]) for i in own]), place[every]] = np.concatenate([shares[i] for i in own])
            wrong, hidden = slopes(mean, vectors[used], soft, bias, y[own], cost[own])
            slope = mean.T @ (wrong @ soft.T)
            seen[used] += (slope * slope).sum(1)
            step = (p.learning_rate / np.sqrt(seen[used]))[:, None]
            moved = vectors[used] - step * slope
            size = np.sqrt((moved * moved).sum(1, keepdims=True))
            vectors[used] = moved * np.maximum(0, 1 - step * p.l1 * len(own) / np.maximum(size, 1e-12))
            soft -= p.softmax_rate * (hidden.T @ wrong) / len(own)
            bias -= 2 * p.softmax_rate * wrong.sum(0) / len(own)
        if 2 * epoch >= epochs - 1:
            odds += vectors @ (soft[:, 1] - soft[:, 0])
            level, averaged_over = level + float(bias[1] - bias[0]), averaged_over + 1
    out = np.zeros(p.buckets, np.float32)
    out[live] = p.scale * odds / averaged_over
    return ToxicityModel(out, level / averaged_over, p)


def slopes(mean: np.ndarray, vectors: np.ndarray, soft: np.ndarray, bias: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slope of the weighted log loss by each text's two outputs, hidden vectors) of texts with bags ``mean``."""
    hidden = mean @ vectors
    z = hidden @ soft + bias
    z -= z.max(1, keepdims=True)
    wrong = np.exp(z)
    wrong /= wrong.sum(1, keepdims=True)
    wrong[np.arange(len(y)), y] -= 1
    return wrong * cost[:, None], hidden


def fit(documents: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Train on at most ``max_train_docs`` labelled documents, chosen by a hash of the id."""
    usable = labelled(labels, "toxic")
    count = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    by_hash = F.xxhash64("doc_id")
    half = p.max_train_docs // 2
    chosen = (
        usable.where("y = 1").orderBy(by_hash, "doc_id").limit(half)
        .union(usable.where("y = 0").orderBy(by_hash, "doc_id").limit(half))
    )
    # at most max_train_docs ids are broadcast; the least text of an id, met before it is moved
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.any_value("y").alias("y"))

    got = map_columns(texts, lambda b: {"bag": pa.array([_squeezed(*averaged(t, p)) for t in byte_texts(b.column("text"))], pa.binary())}, ["doc_id", "y"], "bag binary").toArrow()
    distinct: dict[bytes, int] = {}  # of copies one, under the least id
    for i in np.argsort(np.asarray(got.column("doc_id")), kind="stable").tolist():
        distinct.setdefault(got.column("bag")[i].as_py(), got.column("y")[i].as_py())
    del got
    total = sum(count.values())
    model = train(list(map(_unsqueezed, distinct)), np.array(list(distinct.values()), int), count.get(1, 0) / total if total else 0.0, p)
    release()
    return model


def _squeezed(buckets: np.ndarray, shares: np.ndarray) -> bytes:
    return zstandard.compress(np.diff(buckets, prepend=0).astype("<u4").tobytes() + shares.astype("<f4").tobytes())


def _unsqueezed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, shares = np.split(np.frombuffer(zstandard.decompress(raw), "<u4"), 2)
    return np.cumsum(steps, dtype=np.int32), shares.view("<f4")


_CACHED: list = [None, {}]


def _odds_cache(model: ToxicityModel) -> dict[bytes, float]:
    """The worker's one cache of log-odds, new with each model: broadcast values outlive their stage in a worker."""
    if _CACHED[0] is not model:
        _CACHED[:] = [model, {}]
    return _CACHED[1]


def scores_of(documents: DataFrame, model: ToxicityModel):
    """The column of scores of a text column."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # buckets x 4 bytes, whatever the input

    def scored(texts: pa.Array) -> pa.Array:
        m = shared.value
        return pa.array(m.scores(byte_texts(texts), _odds_cache(m)), pa.float64())

    return column_of(scored, "double", lambda: _odds_cache(shared.value).clear())


def toxicity(documents: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = documents.select("doc_id", scores_of(documents, fit(documents, labels, p))("text").alias("score"))
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= p.threshold).cast("int").alias("predicted"),
    )


def keep_clean(documents: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """The documents, columns as they were, without those predicted toxic: only texts go to Python."""
    return documents.where(scores_of(documents, fit(documents, labels, p))("text") < p.threshold)
