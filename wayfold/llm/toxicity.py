"""Toxicity by subword-bag embeddings under a linear softmax.

Words (runs of letters and digits, lower-cased) are bags of hashed character
n-grams of three to five UTF-8 bytes of ``<word>`` and the word itself.  A word's
vector is its grams' mean; a text's is the mean of its words', each distinct
word weighed by the square root of its count.  A linear softmax over two classes
reads it; embeddings and softmax are trained together in numpy, by mini-batches
with momentum in single precision.  A misspelt or inflected word shares most
grams with the word, so it shares its meaning.

A fifth of the sample is not trained on: its odds set the scale and bias of the
model's, so that 0.7 means the same on texts that were not learned.  The softmax
of two classes is linear in the mean, so a trained model is one number for each
gram; scoring sums a text's words, each distinct word once for each worker
within a bounded memory.

Training looks only at labelled documents with crc32(doc_id) mod 3 not 1, at
about ``SAMPLE`` of each label (by a hash of the id, the same at each run) and,
in that order, at whole texts until ``SAMPLE_BYTES`` of a label are reached (one
text at least).  Both bounds are parameters of ``train``; all documents are
scored over their whole texts, and the model (``BUCKETS`` floats) doesn't grow.

Cases: null, empty and wordless texts get the score of the bias alone (under
0.7).  Without labels of both classes every score is 0.  A document with two labels is
learned as toxic if one says so; null labels and null ids are not learned from,
and null ids are not held out.  Of rows that share an id the least text is
learned from.  Other columns make no difference.
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import drawn, in_budget, in_bytes, table

BITS = 18
BUCKETS = 1 << BITS
DIMENSIONS = 8
GRAMS = (3, 4, 5)
SAMPLE = 1500
SAMPLE_BYTES = 16 << 20
EPOCHS = 8
BATCH = 64
CHECKED = 5
#: A gram's step is its slope over its curvature and this ridge: common grams don't drown the telling ones, rare ones stay near nothing.
RATE, RIDGE, HEAD = 0.002, 1e-4, 0.05
#: Neutral words that every text has besides its own, so that short texts prove little.
NEUTRAL = 40.0
#: Of the mean vector: a text has few toxic words among many.
SCALE = 30.0
TOXIC = 0.7
REMEMBERED = 400_000
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' grams one after the other, and where each word's begin.

    Every word has the bucket of itself at least.
    """
    marked = [f"<{w}>".encode() for w in found]
    sizes = np.array([len(m) for m in marked], np.int64)
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(marked)), sizes)
    end = np.repeat(starts + sizes, sizes)
    prime, places = np.uint64(1099511628211), np.arange(len(data))
    keys, owners = [], []
    rolled = np.zeros(len(data), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        rolled = rolled[: max(0, len(data) - n + 1)] * prime + data[n - 1 :] + np.uint64(1)
        if n in GRAMS:
            inside = places[: len(rolled)] + n <= end[: len(rolled)]
            keys.append(rolled[inside] ^ np.uint64(n))
            owners.append(owner[: len(rolled)][inside])
    weights = prime ** (places - np.repeat(starts, sizes)).astype(np.uint64)
    keys.append(np.add.reduceat(data * weights, starts) if len(starts) else np.zeros(0, np.uint64))
    owners.append(np.arange(len(marked)))
    every, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    mixed = (every ^ (every >> np.uint64(31))) * np.uint64(11400714819323198485)
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)[order], np.searchsorted(owner[order], np.arange(len(marked)))


def _bag(text: str | None) -> dict[str, float]:
    """Distinct words with their weights."""
    return {w: math.sqrt(n) for w, n in Counter(words(text)).items()}


class _Sample:
    """The bags of a sample over its distinct words' grams, read in mini-batches."""

    def __init__(self, texts: list[str]):
        places: dict[str, int] = {}
        self.words, self.shares = [], []
        for text in texts:
            bag = _bag(text)
            self.words.append(np.array([places.setdefault(w, len(places)) for w in bag], np.int32))
            weights = np.fromiter(bag.values(), np.float32, len(bag))
            self.shares.append(weights / (weights.sum() + NEUTRAL))
        buckets, starts = grams(list(places))
        self.buckets, self.starts = buckets.astype(np.int32), starts
        self.sizes = np.diff(np.append(starts, len(buckets)))

    def curvature(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Of each bucket: the summed squares of its shares of documents."""
        squares = np.concatenate([self.shares[d] ** 2 * weight[d] for d in docs])
        of_words = np.bincount(np.concatenate([self.words[d] for d in docs]), squares, len(self.sizes)) / self.sizes**2
        return np.bincount(self.buckets, np.repeat(of_words, self.sizes), BUCKETS) * SCALE**2

    def batch(self, docs: np.ndarray) -> tuple[np.ndarray, ...]:
        """Grams' buckets and words, words' firsts and sizes; pairs' words, shares and documents, documents' firsts."""
        n = np.array([len(self.words[d]) for d in docs])
        found, pair_word = np.unique(np.concatenate([self.words[d] for d in docs]), return_inverse=True)
        sizes = self.sizes[found]
        first = np.cumsum(sizes) - sizes
        at = np.repeat(self.starts[found] - first, sizes) + np.arange(sizes.sum())
        gram_word = np.repeat(np.arange(len(found)), sizes)
        return self.buckets[at], gram_word, first, sizes, pair_word, np.concatenate([self.shares[d] for d in docs]), np.repeat(np.arange(len(docs)), n), np.cumsum(n) - n


def _trained(sample: _Sample, labels: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, float]:
    """(a number for each bucket, the bias) after ``EPOCHS`` rounds of mini-batches over ``docs``."""
    rng = np.random.default_rng(42)
    share = labels[docs].mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    embeddings = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    softmax, bias = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32)
    paces = (1 / (sample.curvature(docs, weight / len(docs)) + RIDGE)).astype(np.float32)[:, None]
    speeds = [np.zeros_like(p) for p in (embeddings, softmax, bias)]

    def scattered(values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(at, values[:, d], size) for d in range(values.shape[1])], axis=1).astype(np.float32)

    for epoch in range(EPOCHS):
        left = 1 - epoch / EPOCHS
        order = rng.permutation(docs)
        for own in np.array_split(order, max(1, len(order) // BATCH)):
            buckets, gram_word, word_first, sizes, pair_word, shares, pair_doc, doc_first = sample.batch(own)
            # means and the softmax are linear: classes go through them in the place of dimensions
            of_words = np.add.reduceat((SCALE * embeddings @ softmax)[buckets], word_first, axis=0) / sizes[:, None]
            logits = np.add.reduceat(of_words[pair_word] * shares[:, None], doc_first, axis=0) + bias
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            target = np.stack([1 - labels[own], labels[own]], axis=1)
            error = (weight[own] / len(own))[:, None] * (odds / odds.sum(axis=1, keepdims=True) - target)
            of_words = scattered(error[pair_doc] * shares[:, None], pair_word, len(sizes)) / sizes[:, None]
            of_buckets = SCALE * scattered(of_words[gram_word], buckets, BUCKETS)
            slopes = (paces * (of_buckets @ softmax.T), embeddings.T @ of_buckets, error.sum(axis=0))
            for speed, value, slope, rate in zip(speeds, (embeddings, softmax, bias), slopes, (RATE, HEAD, HEAD), strict=True):
                speed *= 0.9
                speed += slope
                value -= rate * left * speed
    numbers = SCALE * (embeddings @ (softmax[:, 1] - softmax[:, 0]))
    return numbers.astype(np.float32), float(bias[1] - bias[0])


def _calibration(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the logistic regression of balanced labels on logits, by Newton steps."""
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())) / len(labels)
    x = np.stack([logits, np.ones(len(logits))], axis=1)
    found = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ found, -30, 30)))
        slope = x.T @ (weight * (p - labels)) + 1e-3 * (found - [1.0, 0.0])
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), slope)
        found = found - np.clip(step, -2, 2)
    return max(0.1, float(found[0])), float(found[1])


def fit(texts: list[str], toxic: list[int]) -> tuple[np.ndarray, float]:
    """(a number for each bucket, the bias) of the trained model.

    The model is trained on all documents but every ``CHECKED``-th, whose scores then set
    the scale and bias of the odds: unseen texts get less extreme ones than learned texts.
    """
    known = [(t, y) for t, y in zip(texts, toxic, strict=True) if words(t)]
    labels = np.array([y for _, y in known], np.int64)
    if len(set(labels.tolist())) < 2:
        return np.zeros(BUCKETS, np.float32), -50.0
    sample = _Sample([t for t, _ in known])
    place = np.zeros(len(labels), np.int64)
    for y in (0, 1):  # every CHECKED-th of each label
        place[labels == y] = np.arange((labels == y).sum())
    checked = np.flatnonzero(place % CHECKED == CHECKED - 1)
    numbers, bias = _trained(sample, labels, np.flatnonzero(place % CHECKED != CHECKED - 1))
    if len(set(labels[checked].tolist())) == 2:
        scorer = Scorer(numbers, bias)
        slope, shift = _calibration(np.array([scorer.logit(known[d][0]) for d in checked]), labels[checked])
        numbers, bias = numbers * np.float32(slope), bias * slope + shift
    # a text that says nothing isn't toxic
    return numbers, min(0.0, bias)


class Scorer:
    """Scores texts with a trained model; word values are remembered within a bound."""

    def __init__(self, numbers: np.ndarray, bias: float, most: int = REMEMBERED):
        self.numbers, self.bias, self.most = numbers, bias, most
        self.known: dict[str, float] = {}

    def score(self, text: str | None) -> float:
        if self.bias <= -50.0:
            return 0.0
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.logit(text)))))

    def logit(self, text: str | None) -> float:
        bag = _bag(text)
        found = list(map(self.known.get, bag))
        if None in found:
            lacking = [w for w, f in zip(bag, found, strict=True) if f is None]
            if len(self.known) + len(lacking) > self.most:
                self.known.clear()
                lacking = list(bag)
            buckets, starts = grams(lacking)
            per_word = np.diff(np.append(starts, len(buckets)))
            self.known.update(zip(lacking, (np.add.reduceat(self.numbers[buckets], starts) / per_word).tolist(), strict=True))
            found = list(map(self.known.__getitem__, bag))
        return self.bias + sum(map(operator.mul, found, bag.values())) / (sum(bag.values()) + NEUTRAL)


def _remainder(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 3


def train(
    documents: DataFrame,
    labels: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample: int = SAMPLE,
    sample_bytes: int = SAMPLE_BYTES,
) -> tuple[np.ndarray, float]:
    """A model of a bounded sample: about ``sample`` texts and ``sample_bytes`` of each label."""
    known = (
        labels.select(labels[key].alias("key"), labels[label].alias("label"))
        .where((_remainder(F.col("key")) != 1) & F.col("label").isin(0, 1))
        .groupBy("key")
        .agg(F.max("label").alias("label"))
    )
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    ids = known.where(drawn(sizes, sample))  # about 2 x sample rows: the broadcast is bounded
    texts = documents.select(documents[key].alias("key"), documents[text].alias("text"))
    rows = in_budget(texts.join(F.broadcast(ids), "key"), sample_bytes)
    return fit([r["text"] for r in rows], [r["label"] for r in rows])


def score_documents(documents: DataFrame, model: tuple[np.ndarray, float], *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted for each row; no shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for whole in batches:
            for batch in in_bytes(whole, "text"):
                scores = [scorer.score(t) for t in batch.column(1).to_pylist()]
                yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], names=["key", "score"])

    source = documents.select(documents[key].alias("key"), documents[text].alias("text"))
    scored = source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, score double")
    held = F.coalesce(_remainder(F.col("key")) == 1, F.lit(False))
    return scored.select(F.col("key").alias(key), held.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score_documents(documents, train(documents, table(spark, sf_dir, "labels")))
