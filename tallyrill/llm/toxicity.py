"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its hashed character n-grams (MIN_GRAM to MAX_GRAM, with marks for its ends) and itself; its vector is
the mean of theirs, so an unseen misspelling shares most of its vector with the words it resembles. The vectors of SEGMENT
consecutive words are averaged and go through the softmax; embeddings and softmax are trained together. A text's score
pools its segments' by a softmax-weighted mean (its labels are for whole texts, and one bad passage makes a text bad however
long it is), with weights from the same scores.

In use, the product of an embedding and the softmax is one number for each n-gram bucket, so scoring is a few array passes
over the distinct words of a batch. Training rows are a bounded sample (``most_rows``). A null, empty or wordless text
gets the score of no evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .tables import sampled, small_batches

MIN_GRAM, MAX_GRAM, SEGMENT = 3, 6, 8
POOL = 3.0
#: Parts words: white space and the punctuation between words; signs used inside words stay.
_WORD = X.NOT_SPACE.copy()
_WORD[[ord(c) for c in ".,;:!?\"()[]{}|"]] = False


def word_grams(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram buckets of all words, and the word of each. Words are lower-cased; very long ones count with all their n-grams."""
    n = len(starts)
    size = ends - starts + 2
    at = np.zeros(n + 1, np.int64)
    np.cumsum(size, out=at[1:])
    marked = np.full(at[-1], 1, np.uint8)
    source, which = X.ranges(starts, ends)
    marked[at[which] + 1 + source - starts[which]] = X.LOWER[raw[source]]
    del source, which
    h = np.zeros(len(marked), np.uint32)
    word_of = np.repeat(np.arange(n, dtype=np.int32), size)
    grams, owner = [X.word_hashes(X.LOWER[raw], starts, ends).astype(np.uint32)], [np.arange(n, dtype=np.int32)]
    for k in range(1, MAX_GRAM + 1):
        m = len(marked) - k + 1
        if m <= 0:
            break
        h = (h[:m] ^ marked[k - 1 :]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(13)
        if k >= MIN_GRAM:
            ok = word_of[:m] == word_of[k - 1 :]
            grams.append(h[ok] + np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF))
            owner.append(word_of[:m][ok])
    g = np.concatenate(grams)
    del grams
    g ^= g >> np.uint32(16)
    g *= np.uint32(0x85EBCA6B)
    g ^= g >> np.uint32(13)
    g %= np.uint32(buckets)
    return g.view(np.int32), np.concatenate(owner)


def distinct_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct word, and each word's number among them."""
    _, first, number = np.unique(X.word_hashes(X.LOWER[raw], starts, ends), return_index=True, return_inverse=True)
    return first, number


def segments(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The segment of each word, and each segment's text; texts are cut into segments of near equal size."""
    size = np.diff(at)
    parts = -(-size // SEGMENT)
    base = np.cumsum(parts) - parts
    k, doc = X.ranges(np.zeros(len(size), np.int64), size)
    return base[doc] + k * parts[doc] // np.maximum(size[doc], 1), np.repeat(np.arange(len(size)), parts)


def pooled(logit: np.ndarray, text_of: np.ndarray, n: int, empty: float) -> tuple[np.ndarray, np.ndarray]:
    """Each text's softmax-weighted mean of its segments' logits, and the weights."""
    top = np.full(n, -np.inf)
    np.maximum.at(top, text_of, logit)
    w = np.exp(np.maximum(POOL * (logit - top[text_of]), -50.0))  # no denormal numbers, which are slow
    w /= np.bincount(text_of, weights=w, minlength=n)[text_of]
    out = np.bincount(text_of, weights=w * logit, minlength=n)
    out[~np.isfinite(top)] = empty
    return out, w


@dataclass
class Model:
    """value: what each n-gram bucket adds to the logit of class 1 against class 0."""

    value: np.ndarray
    bias: float

    def logits(self, texts: pa.Array) -> np.ndarray:
        raw, at = X.utf8(texts)
        starts, ends, word_at = X.word_bounds(raw, at, _WORD)
        if not len(starts):
            return np.full(len(at) - 1, self.bias)
        first, number = distinct_words(raw, starts, ends)
        g, word_of = word_grams(raw, starts[first], ends[first], len(self.value))
        word = (np.bincount(word_of, weights=self.value[g], minlength=len(first)) / np.bincount(word_of, minlength=len(first)))[number]
        segment, text_of = segments(word_at)
        logit = np.bincount(segment, weights=word) / np.bincount(segment) + self.bias
        return pooled(logit, text_of, len(at) - 1, self.bias)[0]


def train(texts: list[str], labels: list[int], dims: int = 8, buckets: int = 1 << 18, rounds: int = 60, rate: float = 0.05, decay: float = 1e-5, least_texts: int = 5, seed: int = 1) -> Model:
    """Fits embeddings and softmax together by Adam over all rows, classes weighing alike.

    N-grams of fewer than ``least_texts`` texts keep a zero vector: they would learn single texts by heart. Equal texts count once,
    and are toxic if any of their labels says so. The order of rows has no influence.
    """
    rows: dict[str, int] = {}
    for t, label in sorted(zip(texts, labels, strict=True)):
        rows[t] = label  # of equal texts the last, which is the greatest
    texts, labels = list(rows), list(rows.values())
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        return Model(np.zeros(buckets), float(np.log(p / (1 - p))) if len(y) else -1.0)
    raw, at = X.utf8(pa.array(texts, pa.large_string()))
    starts, ends, word_at = X.word_bounds(raw, at, _WORD)
    first, number = distinct_words(raw, starts, ends)
    g, word_of = word_grams(raw, starts[first], ends[first], buckets)
    n_words = len(first)
    size = np.bincount(word_of, minlength=n_words)
    doc_of = np.repeat(np.arange(len(y)), np.diff(word_at))
    texts_of = np.bincount(np.unique(doc_of * n_words + number) % max(n_words, 1), minlength=n_words)
    frequent = np.bincount(g, weights=texts_of[word_of], minlength=buckets) >= min(least_texts, len(y))
    g, word_of = g[frequent[g]], word_of[frequent[g]]
    known, g = np.unique(g, return_inverse=True)
    g = g.astype(np.int32)
    segment, text_of = segments(word_at)
    length = np.bincount(segment).astype(np.float64)
    # words of a segment as pairs, each once with its count
    pair, count = np.unique(segment * n_words + number, return_counts=True)
    seg, word = (pair // max(n_words, 1)).astype(np.int32), (pair % max(n_words, 1)).astype(np.int32)
    share = count / length[seg]
    del raw, starts, ends, number, doc_of, pair, count, segment
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (len(known), dims))
    soft = rng.normal(0, 0.5, (2, dims))
    bias = np.array([0.0, -4.0])  # texts are taken for clean until an n-gram says otherwise
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (emb, soft, bias)]
    for step in range(1, rounds + 1):
        u = soft[1] - soft[0]
        # the average of a segment times u is the average of its words' projections; gradients pass by the same route
        word_logit = np.bincount(word_of, weights=(emb @ u)[g], minlength=n_words) / size
        logit = np.bincount(seg, weights=share * word_logit[word], minlength=len(length)) + bias[1] - bias[0]
        out, w = pooled(logit, text_of, len(y), bias[1] - bias[0])
        err = (1 / (1 + np.exp(-out)) - y) * weight
        back = err[text_of] * w * (1 + POOL * (logit - out[text_of])) if len(text_of) else np.zeros(0)
        to_word = np.bincount(word, weights=share * back[seg], minlength=n_words) / size
        to_gram = np.bincount(g, weights=to_word[word_of], minlength=len(known))
        grad_u = emb.T @ to_gram
        grads = (np.outer(to_gram, u) + decay * emb, np.stack([-grad_u, grad_u]), np.array([-err.sum(), err.sum()]))
        for p, d, (m, v) in zip((emb, soft, bias), grads, state, strict=True):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    value = np.zeros(buckets)
    value[known] = emb @ (soft[1] - soft[0])
    return Model(value, float(bias[1] - bias[0]))


def sample(docs: DataFrame, labels: DataFrame, most_rows: int) -> tuple[list[str], list[int]]:
    """At most ``most_rows`` labels, half of either kind at most, by a hash of doc_id, and a text of each."""
    known = labels.where(labels["toxic"].isin(0, 1)).select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    own = None
    for y in (0, 1):
        part = sampled(known.where(F.col("toxic") == y), most_rows // 2, F.col("doc_id"))
        own = part if own is None else own.unionByName(part)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    # one text of each label's doc_id, always the same, so no more rows than labels reach the driver
    rows = texts.join(F.broadcast(own), "doc_id").where(F.col("text").isNotNull())
    one = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"), F.max("toxic").alias("toxic"))
    got = one.select("least.text", "toxic").collect()
    return [r[0] for r in got], [r[1] for r in got]


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = 3200) -> Model:
    return train(*sample(docs, labels, most_rows))


SCORED = "doc_id long, score double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: one row for each row of ``docs``, from its whole text alone."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch, "text"):
                out = 1 / (1 + np.exp(-np.clip(model.logits(part.column(1)), -500, 500)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out)], names=["doc_id", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCORED)


def below(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of ``docs`` with a score below the threshold, all columns as they are."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch, "text"):
                ok = 1 / (1 + np.exp(-np.clip(model.logits(part.column(at)), -500, 500))) < threshold
                yield part.filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)
