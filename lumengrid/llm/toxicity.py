"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly.

A word is the mean of the vectors of its character n-grams, a window the mean of its words,
and a linear softmax reads the window.  Vectors and softmax are trained together by
full-batch Adam in numpy.  A text scores as its worst window, so a few words in a long text count; a
logistic curve over that and the text's length, fitted on sampled texts that the
model behind it has not learned from, makes it a probability.  Unseen misspellings share n-grams, hence
vectors, with known words.

The classifier is fitted in one task on a bounded sample of labelled rows (:class:`Training`), each with
its whole text; every whole text is scored.

Defined results: null and empty texts score as a window without words; a text
shorter than a window is one window; without labels of both kinds all
documents score 0; of conflicting labels of an id the higher holds; where rows share an id, the one whose text has the
least hash is learned from; repeated rows are scored alike; all columns of the scored table stay, and one that has the
name of the score is replaced.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

_EDGE = "".join(map(chr, range(33, 127))).translate({ord(c): None for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"}) + "«»“”„‘’…¿¡"


@dataclass(frozen=True)
class Training:
    """Bounds of the sample (documents, taken by hash order) and the model's size.

    ``calm`` keeps the moves of n-grams with little evidence small; ``least``: documents that an n-gram must have;
    ``each``: windows of a document that a stage learns from, the worst ones; ``folds``: parts of the sample that are held out in turn for the curve;
    ``miss``: clean documents that a toxic one counts as there.
    """

    toxic_documents: int = 600
    clean_documents: int = 1400
    window: int = 1
    buckets: int = 1 << 17
    dimensions: int = 4
    stages: int = 7
    steps: int = 12
    rate: float = 0.3
    calm: float = 1e-4
    least: int = 5
    each: int = 2
    folds: int = 2
    miss: float = 2.0
    memo: int = 300_000


def normal_words(text: str) -> list[str]:
    return [w.strip(_EDGE) or w for w in text.lower().split()]


def grams(word: str, buckets: int) -> list[int]:
    """Buckets of the word and its character n-grams of 3 to 5."""
    data = f"<{word}>".encode("utf-16-le", "surrogatepass")
    n = len(data) // 2
    crc = zlib.crc32
    out = [crc(data) % buckets]
    for k in (3, 4, 5):
        out += [crc(data[2 * i : 2 * (i + k)]) % buckets for i in range(n - k + 1)]
    return out


@dataclass
class Model:
    """``weights``: each bucket's part of the softmax's log odds; ``bias`` of a window; ``curve`` of a document: slopes of the log odds and of the length, height."""

    weights: np.ndarray
    bias: float
    curve: tuple[float, float, float]
    window: int
    memo: int

    def __post_init__(self) -> None:
        self.known: dict[str, float] = {}

    def _word(self, word: str) -> float:
        if len(self.known) > self.memo:
            self.known.clear()
        value = self.known[word] = float(self.weights[grams(word, len(self.weights))].mean())
        return value

    def logit(self, words: list[str]) -> float:
        """Log odds of the worst window."""
        if not words:
            return self.bias
        known = self.known
        each = np.fromiter((known[w] if w in known else self._word(w) for w in words), np.float64, len(words))
        if len(each) <= self.window:
            return self.bias + float(each.mean())
        total = np.concatenate([[0.0], np.cumsum(each)])
        return self.bias + float((total[self.window :] - total[: -self.window]).max()) / self.window

    def score(self, text: str) -> float:
        words = normal_words(text)
        a, c, b = self.curve
        return float(1 / (1 + np.exp(-np.clip(a * self.logit(words) + c * np.log1p(len(words)) + b, -50, 50))))


class Sample:
    """Whole texts as word numbers, and the n-grams of each word."""

    def __init__(self, texts: list[str | None], buckets: int) -> None:
        index: dict[str, int] = {}
        parts = [np.fromiter((index.setdefault(w, len(index)) for w in normal_words(t or "")), np.int32) for t in texts]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate([*parts, np.zeros(0, np.int32)])
        bags = [np.asarray(grams(w, buckets), np.int32) for w in index]
        self.n_words = len(bags)
        self.owner = np.repeat(np.arange(self.n_words, dtype=np.int32), [len(b) for b in bags])
        self.gram = np.concatenate([*bags, np.zeros(0, np.int32)])
        self.per_word = np.maximum(1.0, np.bincount(self.owner, minlength=self.n_words))
        doc = np.repeat(np.arange(len(parts), dtype=np.int64), self.sizes)
        both = np.unique(doc * max(1, self.n_words) + self.flat)
        self.holder, self.held = both // max(1, self.n_words), both % max(1, self.n_words)

    def values(self, weights: np.ndarray, window: int, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, place, length and log odds without the bias of all windows of ``docs``; one at least of each."""
        n = np.maximum(1, self.sizes[docs] - window + 1)
        doc = np.repeat(docs.astype(np.int32), n)
        at = self.starts[doc] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        length = np.minimum(window, self.sizes[doc])
        value = np.bincount(self.owner, weights[self.gram], self.n_words) / self.per_word
        total = np.concatenate([[0.0], np.cumsum(value[self.flat])])
        return doc, at, length, (total[at + length] - total[at]) / np.maximum(1, length)

    def worst(self, weights: np.ndarray, bias: float, window: int) -> np.ndarray:
        doc, _, _, value = self.values(weights, window, np.arange(len(self.sizes)))
        return bias + np.maximum.reduceat(value, np.searchsorted(doc, np.arange(len(self.sizes))))


def learn(sample: Sample, label: np.ndarray, docs: np.ndarray, cfg: Training) -> tuple[np.ndarray, float]:
    """Joint training on ``docs`` of the sample: weights by bucket, and the bias.

    It starts from whole texts.  A document is judged by its worst window, so training goes on, stage by stage, with
    the windows of each document that the model so far finds worst.
    N-grams seen in fewer than ``least`` documents say nothing about others and stay at zero.
    """
    mine = np.isin(sample.holder, docs)
    common = np.bincount(sample.gram, np.bincount(sample.held[mine], minlength=sample.n_words)[sample.owner], cfg.buckets) >= cfg.least
    kept = common[sample.gram]
    owner = sample.owner[kept]
    used, gram = np.unique(sample.gram[kept], return_inverse=True)
    rng, d = np.random.default_rng(7), cfg.dimensions
    params = [rng.normal(0, 0.1, (len(used), d)), rng.normal(0, 0.5, (d, 2)), np.zeros(2)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]

    def summed(values: np.ndarray, of: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(to, values[of, k], n) for k in range(d)], 1)

    doc, at, length = docs, sample.starts[docs], sample.sizes[docs]
    weights, bias, t = np.zeros(cfg.buckets), 0.0, 0
    for _ in range(cfg.stages):
        # the words and n-grams of the chosen windows, numbered anew
        row = np.repeat(np.arange(len(doc)), length)
        place = np.repeat(at, length) + np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
        word_of, words_used = np.unique(sample.flat[place], return_inverse=True)
        own = np.isin(owner, word_of)
        g, o = gram[own], np.searchsorted(word_of, owner[own])
        size, many = sample.per_word[word_of][:, None], np.maximum(1.0, length)[:, None]
        y = label[doc]
        part = 1.0 / np.bincount(doc, minlength=len(label))[doc]
        weight = (part * np.where(y == 1, 0.5 / max(1.0, part[y == 1].sum()), 0.5 / max(1.0, part[y == 0].sum())))[:, None]
        for _ in range(cfg.steps):
            t += 1
            words = summed(params[0], g, o, len(word_of)) / size
            x = summed(words, words_used, row, len(doc)) / many
            z = x @ params[1] + params[2]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            dz = (p - np.eye(2)[y]) * weight
            dwords = summed(dz @ params[1].T / many, row, words_used, len(word_of)) / size
            for q, d_, (m, v) in zip(params, (summed(dwords, o, g, len(used)), x.T @ dz, dz.sum(0)), moments, strict=True):
                m += 0.1 * (d_ - m)
                v += 0.01 * (d_ * d_ - v)
                q -= cfg.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + cfg.calm)
        weights[used] = params[0] @ (params[1][:, 1] - params[1][:, 0])
        bias = float(params[2][1] - params[2][0])
        doc, at, length, value = sample.values(weights, cfg.window, docs)
        order = np.lexsort((-value, doc))
        chosen = np.sort(order[np.arange(len(order)) - np.searchsorted(doc[order], doc[order]) < cfg.each])
        doc, at, length = doc[chosen], at[chosen], length[chosen]
    return weights, bias


def train(texts: list[str | None], label: np.ndarray, share: float, cfg: Training = Training()) -> Model:
    """A model of whole texts; ``share`` is the part of positive documents to calibrate for.

    The curve is fitted on log odds that each part of the sample gets from a model of the other parts.
    """
    sample = Sample(texts, cfg.buckets)
    every = np.arange(len(texts))
    weights, bias = learn(sample, label, every, cfg)
    odds = sample.worst(weights, bias, cfg.window)
    part = np.array([zlib.crc32((t or "").encode("utf-8", "surrogatepass")) for t in texts], np.int64) % cfg.folds
    for k in range(cfg.folds):
        others = every[part != k]
        if len(np.unique(label[others])) == 2:
            odds[part == k] = sample.worst(*learn(sample, label, others, cfg), cfg.window)[part == k]
    curve = _logistic(np.stack([odds, np.log1p(sample.sizes)], 1), label, share * cfg.miss / (share * cfg.miss + 1 - share))
    return Model(weights, bias, curve, cfg.window, cfg.memo)


def _logistic(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float, float]:
    """Slopes and height of a ridge logistic curve by Newton's method, weighted to the given share of positives."""
    w = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    mean, sd = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    design, ridge = np.column_stack([(x - mean) / sd, np.ones(len(y))]), np.diag([0.1, 0.1, 0.0])
    a = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ a, -30, 30)))
        hess = (design * (w * p * (1 - p) + 1e-9)[:, None]).T @ design + ridge
        a -= np.linalg.solve(hess, design.T @ (w * (p - y)) + ridge @ a)
    slopes = a[:2] / sd
    return float(slopes[0]), float(slopes[1]), float(a[2] - slopes @ mean)


def _trained(share: float, cfg: Training):
    """The one task of the fit: the whole sample in, the pickled model out; nothing without labels of both kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), key=lambda r: (r[0] or "", r[1]))
        label = np.array([y for _, y in rows], np.int64)
        if len(np.unique(label)) == 2:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([t for t, _ in rows], label, share, cfg))], pa.binary())], names=["model"])

    return run


def fit(docs: DataFrame, labels: DataFrame, cfg: Training = Training()) -> Model | None:
    """Train on ``docs(doc_id, text)`` and ``labels(doc_id, label)``."""
    small_batches(docs.sparkSession)
    one = labels.filter("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    some = one.filter("label = 1").orderBy(*order).limit(cfg.toxic_documents).union(one.filter("label = 0").orderBy(*order).limit(cfg.clean_documents))
    some = written(some, "sample")  # as many rows as cfg says, at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    share = one.agg(F.avg(F.col("label").cast("double"))).first()[0]
    found = texts.select("text", "label").repartition(1).mapInArrow(_trained(float(share or 0.0), cfg), "model binary").collect()  # one row, as large as the model
    return pickle.loads(found[0]["model"]) if found else None


def score(docs: DataFrame, model: Model | None, column: str = "score") -> DataFrame:
    """Adds a score from 0 to 1 to every row of ``docs(text, ...)``."""
    if model is None:
        return docs.withColumn(column, F.lit(0.0))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as its buckets, whatever the input

    @F.pandas_udf("double")
    def scored(texts):
        own = shared.value
        return texts.map(lambda t: own.score(t or ""))

    return docs.withColumn(column, scored("text"))
