"""Language identification by nearest centroids.

A text is lower-cased, runs of other characters than letters become one space,
and its UTF-8 bytes' two- and three-grams are counted in ``BUCKETS`` hashed
buckets.  Vectors are log term frequency times inverse document frequency, of
length one.  Each language has ``CENTROIDS`` centroids (spherical k-means on
its sample); a text gets the language of the centroid with the largest cosine,
which is its score.

Rejection: the sample's texts are cut to ``LENGTHS`` bytes of letters; at each
length, a language's bound is ``REJECT`` times the ``QUANTILE`` of its cut
texts' cosines with its centroids, so a few noisy texts don't move it.  A text
is rejected if its cosine is under the bound of the longest length that it has,
or if it has no letter.  Lengths with under ``LEAST`` texts, or with a lower
bound than a shorter one, take the shorter one's.

Training looks only at ``text`` and non-null ``lang`` of documents with
crc32(doc_id) mod 4 not 2: of the ``LANGUAGES`` most frequent languages at about
``SAMPLE`` documents each (by a hash of the id, the same at each run) and, in
that order, at whole texts until ``SAMPLE_BYTES`` of a language are reached (one
text at least).  These bounds are parameters of ``train``; all documents are
scored over their whole texts, and the model (``BUCKETS`` floats for each
centroid) doesn't grow with the corpus.

Cases: null texts and texts without letters are ``und`` with score 0, and so is
every text if nothing could be learned.  Rows with a null id are not learned
from and not held out.  Of rows that share an id and a language the least text
is learned from.  Other columns make no difference.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm.common import drawn, fresh, in_budget, in_bytes, table

BUCKETS = 1 << 13
CENTROIDS = 4
SAMPLE = 400
SAMPLE_BYTES = 4 << 20
LANGUAGES = 100
REJECT = 0.6
QUANTILE = 0.02
LENGTHS = (1, 4, 8, 16, 32, 128, 512, 2048)
LEAST = 10
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")
_CHUNK = 1 << 20


def _letters(text: str | None) -> bytes | None:
    """The words of a text in lower case; None if it has no letter."""
    letters = _OTHER.sub(" ", (text or "").lower())
    return letters.strip().encode() if any(map(str.isalpha, letters)) else None


def counts(text: str | None) -> np.ndarray | None:
    """Bucket counts of a text's byte two- and three-grams; None if it has no letter."""
    letters = _letters(text)
    return None if letters is None else _counts(letters)


def _counts(letters: bytes) -> np.ndarray:
    data = np.frombuffer(b" " + letters + b" ", np.uint8)
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data) - 1, _CHUNK):
        part = data[at : at + _CHUNK + 2].astype(np.uint32)
        pair = part[:-1] * np.uint32(257) + part[1:]
        own = pair[: min(_CHUNK, len(pair))] * np.uint32(2654435761) >> np.uint32(32 - 13)
        total += np.bincount(own, minlength=BUCKETS)
        if len(part) > 2:
            triple = (pair[:-1] * np.uint32(263) + part[2:] + np.uint32(70001))[:_CHUNK]
            total += np.bincount(triple * np.uint32(2246822519) >> np.uint32(32 - 13), minlength=BUCKETS)
    return total


@dataclass
class Model:
    languages: list[str]
    owners: np.ndarray  # of each centroid, its place in languages
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray  # of each language and length of LENGTHS, the cosine under which a text is rejected

    def vector(self, count: np.ndarray) -> np.ndarray:
        v = np.log1p(count).astype(np.float32) * self.idf
        return v / max(float(np.linalg.norm(v)), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)"""
        letters = _letters(text)
        if letters is None or not self.languages:
            return UNKNOWN, 0.0, True
        cosines = self.centroids @ self.vector(_counts(letters))
        best = int(np.argmax(cosines))
        score = float(min(1.0, max(0.0, cosines[best])))
        owner = int(self.owners[best])
        return self.languages[owner], score, score < float(self.least[owner, _length(letters)])


def _length(letters: bytes) -> int:
    """The place in LENGTHS of the longest length that a text has."""
    return bisect.bisect_right(LENGTHS, len(letters)) - 1


def _bounds(model: Model, texts: list[bytes], centroids: np.ndarray) -> np.ndarray:
    """Of each length of LENGTHS, the cosine under which a text of this language is rejected."""
    out = np.zeros(len(LENGTHS))
    for at, n in enumerate(LENGTHS):
        own = [float((centroids @ model.vector(_counts(t[:n]))).max()) for t in texts if len(t) >= n]
        shorter = out[at - 1] if at else 0.0
        out[at] = max(shorter, REJECT * float(np.quantile(own, QUANTILE))) if len(own) >= LEAST else shorter
    return out


def _clusters(vectors: np.ndarray, n: int) -> np.ndarray:
    """Unit centroids of spherical k-means, started from the mean and its farthest vectors."""
    centres = [vectors.mean(axis=0)]
    while len(centres) < min(n, len(vectors)):
        nearest = np.max(vectors @ (np.array(centres) / np.linalg.norm(centres, axis=1, keepdims=True)).T, axis=1)
        centres.append(vectors[int(np.argmin(nearest))])
    centroids = np.array(centres)
    for _ in range(12):
        centroids = centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
        nearest = np.argmax(vectors @ centroids.T, axis=1)
        centroids = np.array([vectors[nearest == k].sum(axis=0) if (nearest == k).any() else centroids[k] for k in range(len(centroids))])
    return centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)


def fit(rows: list[tuple[str, str]], n: int = CENTROIDS) -> Model:
    """A model of (lang, text) rows; rows without letters are left out."""
    read = [(lang, letters) for lang, text in rows if (letters := _letters(text)) is not None]
    counted = [(lang, _counts(letters)) for lang, letters in read]
    languages = sorted({lang for lang, _ in counted})
    seen = sum((c > 0 for _, c in counted), np.zeros(BUCKETS, np.int64))
    idf = (np.log((1 + len(counted)) / (1 + seen)) + 1).astype(np.float32)
    model = Model(languages, np.zeros(0, np.int64), np.zeros((0, BUCKETS), np.float32), idf, np.zeros((len(languages), len(LENGTHS))))
    owners, centroids = [], []
    for at, lang in enumerate(languages):
        vectors = np.array([model.vector(c) for own, c in counted if own == lang])
        found = _clusters(vectors, n)
        model.least[at] = _bounds(model, [letters for own, letters in read if own == lang], found)
        owners += [at] * len(found)
        centroids.append(found)
    model.owners = np.array(owners, np.int64)
    model.centroids = np.concatenate(centroids).astype(np.float32) if centroids else model.centroids
    return model


def _remainder(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 4


def train(
    documents: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample: int = SAMPLE,
    sample_bytes: int = SAMPLE_BYTES,
    languages: int = LANGUAGES,
) -> Model:
    """A model of a bounded sample: about ``sample`` texts and ``sample_bytes`` of each of ``languages`` languages."""
    learn = documents.select(documents[key].alias("key"), documents[text].alias("text"), documents[lang].alias("label")).where(
        (_remainder(F.col("key")) != 2) & F.col("label").isNotNull() & F.col("text").isNotNull()
    )
    # ids and not rows are counted: a repeated id is drawn once
    most = learn.groupBy("label").agg(F.approx_count_distinct("key").alias("n")).orderBy(F.desc("n"), "label").limit(languages)
    sizes = {r["label"]: r["n"] for r in most.collect()}
    if not sizes:
        return fit([])
    return fit([(r["label"], r["text"]) for r in in_budget(learn.where(drawn(sizes, sample)), sample_bytes)])


def _scored(documents: DataFrame, model: Model, names: tuple[str, str, str], text: str) -> DataFrame:
    """``documents`` with three more columns: language, score, rejected."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for batch in in_bytes(whole, text):
                found = [own.predict(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
                for name, values, kind in zip(names, zip(*found, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True):
                    batch = batch.append_column(name, pa.array(values, kind))
                yield batch

    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))]))


def identify(documents: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", model: Model | None = None) -> DataFrame:
    """key, held_out, lang_pred, score, rejected for each row; no shuffle but the training counts."""
    model = model or train(documents, key=key, text=text, lang=lang)
    source = documents.select(documents[key].alias("key"), documents[text].alias("text"))
    held = F.coalesce(_remainder(F.col("key")) == 2, F.lit(False))
    return _scored(source, model, ("lang_pred", "score", "rejected"), "text").select(F.col("key").alias(key), held.alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(documents: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", model: Model | None = None) -> DataFrame:
    """The documents that are not rejected, all columns kept."""
    model = model or train(documents, key=key, text=text, lang=lang)
    names = tuple(fresh(n, documents.columns) for n in ("_lang_pred", "_lang_score", "_lang_rejected"))
    return _scored(documents, model, names, text).where(~F.col(names[2])).select(*documents.columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
