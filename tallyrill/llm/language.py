"""Language identification in two steps: a family first, then one-versus-one linear support vector machines within it.

Features are the frequencies of hashed byte n-grams (1 to MOST_GRAM bytes) of the lower-cased text, letters only: anything
else counts as one space. All machines are linear, so a text's decision values are means over its n-grams, and whole texts
of any length are scored in one pass. Models are fitted in numpy on a bounded sample of labelled rows (``most_rows``),
as many of each language. A text's features are its own, whatever other texts are in the batch.

A text that is null or has no letter is ``und`` with score 0; so is every text where nothing was learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import text as X
from .tables import small_batches

#: Families of the ISO 639-1 codes; a language that isn't here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "mt"),
    "indo-aryan": ("hi", "bn", "ur", "mr", "ne", "gu", "pa"),
}
MOST_GRAM = 4
_LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def family(lang: str) -> str:
    return next((f for f, own in FAMILIES.items() if lang in own), lang)


def grams(raw: np.ndarray, at: np.ndarray, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length the features of the n-grams, the offsets of each text's, and how many each text has.

    A text begins and ends with one space, and repeated spaces are one. The last places of a text, where an n-gram would go on
    into the next one, hold the feature ``dims``, which has no weight, so a text's features are its own wherever it stands.
    """
    n = len(at) - 1
    if not n:
        return
    low = np.insert(_LETTERS[raw], np.repeat(at, 2)[1:-1], 32)
    at = at + 2 * np.arange(n + 1)
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    keep[at[:-1]] = True
    low = low[keep]
    at = np.concatenate([[0], np.cumsum(keep)])[at]
    size = np.diff(at)
    h = np.zeros(len(low), np.uint32)
    for k in range(1, MOST_GRAM + 1):
        have = max(len(low) - k + 1, 0)
        h[:have] = (h[:have] ^ low[k - 1 :]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        m = h * np.uint32(0x9E3779B1)
        m ^= m >> np.uint32(16)
        m = (m % np.uint32(dims)).astype(np.int32)
        for j in range(1, min(k, len(low) + 1)):
            m[(at[1:] - j)[size >= j]] = dims
        yield m, at, np.maximum(size - k + 1, 0)


def frequencies(texts: list[str], dims: int) -> np.ndarray:
    out = np.zeros((len(texts), dims), np.float32)
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        n = 0
        for h, _, count in grams(raw, np.array([0, len(raw)]), dims):
            out[i] += np.bincount(h, minlength=dims + 1)[:dims]
            n += int(count[0])
        out[i] /= max(n, 1)
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 120) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by accelerated gradient descent; classes weigh alike. y: 1 or -1."""
    n, d = x.shape
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    rate = 1.0 / (2.0 * float((weight * (np.einsum("ij,ij->i", x, x) + 1)).sum()) + penalty)
    w = v = np.zeros(d, np.float32)
    b = c = 0.0
    t = 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v + c)) * weight * y
        w2 = v + rate * (2 * slack @ x - penalty * v)
        b2 = c + rate * 2 * float(slack.sum())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


@dataclass
class Model:
    """Weights of all machines as columns: families one against the rest, then the pairs of languages within each."""

    dims: int
    langs: dict[str, list[str]] = field(default_factory=dict)
    columns: list[tuple] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None

    def decide(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Languages and scores from the texts' decision values."""
        at = {c: i for i, c in enumerate(self.columns)}
        names = list(self.langs)
        p = np.exp(2 * (margin := np.stack([values[:, at["family", f]] if ("family", f) in at else np.zeros(len(values)) for f in names], 1)) - 2 * margin.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        which = p.argmax(1)
        lang, score = np.empty(len(values), object), np.zeros(len(values))
        for k, f in enumerate(names):
            rows, own = np.flatnonzero(which == k), self.langs[f]
            votes, sure = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own)))
            for i, j in combinations(range(len(own)), 2):
                s = 1 / (1 + np.exp(-3 * values[rows, at["pair", own[i], own[j]]]))
                votes[:, i] += s >= 0.5
                votes[:, j] += s < 0.5
                sure[:, i] += s
                sure[:, j] += 1 - s
            best = (votes + sure / (len(own) + 1)).argmax(1) if len(rows) else np.empty(0, int)
            lang[rows] = np.array(own, object)[best]
            score[rows] = p[rows, k] * (sure[np.arange(len(rows)), best] / (len(own) - 1) if len(own) > 1 else 1)
        return lang, np.clip(score, 0, 1)


def fit(texts: list[str], langs: list[str], dims: int = 4096) -> Model:
    model = Model(dims)
    for lang in sorted(set(langs)):
        model.langs.setdefault(family(lang), []).append(lang)
    if not langs:
        return model
    x, y = frequencies(texts, dims), np.array(langs)
    scale = 1 / np.sqrt(x.mean(0) + 1e-5)
    x *= scale
    of = np.array([family(v) for v in langs])
    weights, bias = [], []
    for f, own in model.langs.items():
        if len(model.langs) > 1:
            model.columns.append(("family", f))
            w, b = linear_svm(x, np.where(of == f, 1, -1).astype(np.float32))
            weights.append(w * scale)
            bias.append(b)
        for i, j in combinations(own, 2):
            rows = (y == i) | (y == j)
            model.columns.append(("pair", i, j))
            w, b = linear_svm(x[rows], np.where(y[rows] == i, 1, -1).astype(np.float32))
            weights.append(w * scale)
            bias.append(b)
    model.weights = np.stack(weights, 1).astype(np.float32) if weights else np.zeros((dims, 0), np.float32)
    model.bias = np.array(bias, np.float32)
    return model


def has_letter(part: pa.Array) -> np.ndarray:
    raw, at = X.utf8(part)
    n = len(at) - 1
    low = _LETTERS[raw]
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
    ascii_ = count((low >= 97) & (low <= 122)) > 0
    for i in np.flatnonzero(~ascii_ & (count(raw >= 128) > 0)):
        ascii_[i] = any(c.isalpha() for c in part[int(i)].as_py())
    return ascii_ if n else np.empty(0, bool)


def predict(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, at = X.utf8(texts)
    n = len(at) - 1
    if not model.langs:
        return np.full(n, "und", object), np.zeros(n)
    total, count = np.zeros((n, model.weights.shape[1])), np.zeros(n)
    weights = np.append(model.weights, np.zeros((1, model.weights.shape[1]), np.float32), 0).T.astype(np.float64, order="C")
    for h, own, many in grams(raw, at, model.dims):
        count += many
        for c in range(total.shape[1]):
            total[:, c] += np.add.reduceat(weights[c][h], own[:-1])
    lang, score = model.decide(total / np.maximum(count, 1)[:, None] + model.bias)
    none = ~has_letter(texts)
    lang[none], score[none] = "und", 0.0
    return lang, score


def sample(docs: DataFrame, most_rows: int, most_langs: int = 500) -> tuple[list[str], list[str]]:
    """Labelled rows for training, least by a hash of doc_id and text: as many of each language, ``most_rows`` in all, but 20 of each at least.

    Rare languages so have their rows, however large the corpus. Of more than ``most_langs`` distinct labels the most frequent are learned.
    """
    rows = docs.where(docs["lang"].isNotNull() & docs["text"].isNotNull()).select(docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"), docs["doc_id"])
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()}
    if not counts:
        return [], []
    each = max(20, most_rows // len(counts))
    # a threshold that lets through somewhat more than is wanted of each language, in one pass; what is over goes by the same hash
    limit = [(lang, min(int((2 * (each + 6 * each**0.5) / n - 1) * (1 << 63)), (1 << 63) - 1)) for lang, n in counts.items()]
    h = F.xxhash64("doc_id", "text").alias("h")
    some = rows.select("text", "lang", h).join(F.broadcast(docs.sparkSession.createDataFrame(limit, "lang string, most long")), "lang").where("h <= most")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    got = sorted((r["lang"], r["h"], r["text"]) for r in some.withColumn("nth", nth).where(F.col("nth") <= each).collect())
    return [t for _, _, t in got], [lang for lang, _, _ in got]


PREDICTED = "doc_id long, lang_pred string, score double"


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score: one row for each row of ``docs``, from its text alone. The model's size is fixed by its dims and languages."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch, "text"):
                lang, score = predict(model, part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, PREDICTED)


def learn(docs: DataFrame, most_rows: int = 2500, dims: int = 4096) -> Model:
    return fit(*sample(docs, most_rows), dims)
