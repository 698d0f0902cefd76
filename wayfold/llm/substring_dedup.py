"""Substring deduplication by sliding sentence spans.

Sentences end at line feeds and after ``.``, ``!`` or ``?`` before white space.
A sentence of more than ``LONG`` words is cut on after the words that a hash of
the word chooses (one in ``CUT``), after a word's repetition and after ``MOST``
words without a cut, so that passages without stops have cut points too; they
are the same wherever the passage stands, from its first chosen word on.

A span is the shortest run from a sentence on that has ``sentences`` sentences
and ``least_words`` words at least (parameters); its hash is over its words (lower-cased, without
punctuation).  Of all spans with one hash in all documents only the first
stays: in the document with the least id, there at the first place.  A sentence
that any other one covers is removed.  So any passage of over 50 words that
repeats loses its later copies, up to the incomplete sentences at its edges.

Plan: one row (hash, id) for each distinct span of a document, written once to
the shared checkpoint folder and read by both sides of the search: the owner of
a hash is an aggregate with partial sums, and rows of hashes that others own
are found by a join that may be split under skew, then gathered by document (as
many as it has spans) and checkpointed; then the spans are deleted.  Only
documents that lose something are cut anew.  Hashes have 64 bits and decide
alone; two different spans share one at odds of about the square of their
number over 2^65.

Cases: null texts stay null.  A text with fewer than ``sentences`` sentences or
``least_words`` words has no span: it is never changed, however often it
repeats (exact copies of short texts are the near-duplicate operator's matter).
Rows that share an id are one document to the others: none of them loses
sentences to another of them.  Rows without an id are documents of their own,
after all others and told apart by their texts' hashes, of which the least is
first; equal texts without an id are one document.  Other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import checkpoint_folder, checkpointed, delete_folder, in_bytes, table

SENTENCES = 3
WORDS = 15
LONG = 12
CUT = 6
MOST = 8
_SENTENCE = re.compile(r"[^\n]*?[.!?]+(?=\s|$)|[^\n]+", re.MULTILINE)
_WORD = re.compile(r"[^\W_]+")


class _Cuts(dict):
    """Whether a long sentence is cut after a word; bounded."""

    def __missing__(self, word: str) -> bool:
        if len(self) > 500_000:
            self.clear()
        self[word] = found = zlib.crc32(word.encode()) % CUT == 0
        return found


_CUTS = _Cuts()


def _lowered(text: str) -> str:
    """Lower case with every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def _bounds(said: list[str]) -> list[int]:
    """Ends of the pieces of a sentence's words."""
    if len(said) <= LONG:
        return [len(said)]
    cuts, ends, last, before = _CUTS, [], 0, ""
    for n, word in enumerate(said, 1):
        if cuts[word] or before == word or n - last >= MOST:
            ends.append(n)
            last = n
        before = word
    return ends if last == len(said) else [*ends, len(said)]


def spoken(text: str) -> list[tuple[str, int]]:
    """(words joined by spaces, how many) of every sentence with words."""
    out = []
    for sentence in _SENTENCE.findall(_lowered(text)):
        said = _WORD.findall(sentence)
        if said:
            at = 0
            for end in _bounds(said):
                out.append((" ".join(said[at:end]), end - at))
                at = end
    return out


def places(text: str) -> list[tuple[int, int]]:
    """(start, end) of the same sentences, without a gap inside a long one."""
    out = []
    for m in _SENTENCE.finditer(_lowered(text)):
        words = list(_WORD.finditer(m[0]))
        if words:
            at, bounds = m.start(), _bounds([w[0] for w in words])
            for end in bounds:
                stop = m.end() if end == len(words) else m.start() + words[end - 1].end()
                out.append((at, stop))
                at = stop
    return out


def spans(found: list[tuple[str, int]], sentences: int = SENTENCES, least_words: int = WORDS) -> list[tuple[int, int, int]]:
    """(first sentence, end, hash) of every span."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words, sizes = [w for w, _ in found], [n for _, n in found]
    out, end, held = [], 0, 0
    for at in range(len(found)):
        while end < len(found) and (end - at < sentences or held < least_words):
            held += sizes[end]
            end += 1
        if end - at < sentences or held < least_words:
            break
        out.append((at, end, digest(" ".join(words[at:end])) - (1 << 63)))
        held -= sizes[at]
    return out


def remaining(text: str, others: set[int], sentences: int = SENTENCES, least_words: int = WORDS) -> tuple[str, int]:
    """(text without covered sentences, sentences removed); ``others``: hashes whose first span is elsewhere."""
    found = spoken(text)
    covered, seen = bytearray(len(found)), set()
    for at, end, value in spans(found, sentences, least_words):
        if value in others or value in seen:
            covered[at:end] = b"\1" * (end - at)
        seen.add(value)
    if not any(covered):
        return text, 0
    kept, at = [], 0
    for (start, end), gone in zip(places(text), covered, strict=True):
        if gone:
            kept.append(text[at:start])
            at = end
    return "".join([*kept, text[at:]]), sum(covered)


def span_rows(documents: DataFrame, sentences: int = SENTENCES, least_words: int = WORDS) -> DataFrame:
    """hash, key, tie and again (it is there more than once) of each distinct span of each row of (key, tie, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in in_bytes(whole, "text"):
                keys, ties, hashes, again = [], [], [], []
                for key, tie, text in zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True):
                    every = [h for _, _, h in spans(spoken(text), sentences, least_words)] if text else []
                    own = set(every)
                    hashes += own
                    keys += [key] * len(own)
                    ties += [tie] * len(own)
                    if len(own) == len(every):
                        again += [False] * len(own)
                    else:
                        twice, seen = set(), set()
                        for h in every:
                            (twice if h in seen else seen).add(h)
                        again += [h in twice for h in own]
                yield pa.record_batch([pa.array(hashes, pa.int64()), pa.array(keys, pa.int64()), pa.array(ties, pa.int64()), pa.array(again, pa.bool_())], names=["hash", "key", "tie", "again"])

    return documents.mapInArrow(run, "hash long, key long, tie long, again boolean")


def _losses(rows: DataFrame) -> DataFrame:
    """key, tie, others: of each document that loses something, the hashes that other documents own."""
    owners = (
        rows.groupBy("hash")
        .agg(F.min("key").alias("first"), F.max("key").alias("last"), F.min("tie").alias("first_tie"), F.max("tie").alias("last_tie"))
        .where("first < last OR (first IS NOT NULL AND first_tie IS NOT NULL) OR first_tie < last_tie")
        .select("hash", "first", "first_tie")
    )
    # documents with an id are before those without
    later = (F.col("key") > F.col("first")) | (F.col("key").isNull() & (F.col("first").isNotNull() | (F.col("tie") > F.col("first_tie"))))
    elsewhere = rows.select("hash", "key", "tie").join(owners, "hash").where(later).select("key", "tie", "hash")
    within = rows.where("again").select("key", "tie", F.lit(None).cast("long").alias("hash"))
    return elsewhere.unionAll(within).groupBy("key", "tie").agg(F.collect_set("hash").alias("others"))


def deduplicate(documents: DataFrame, *, key: str = "doc_id", text: str = "text", sentences: int = SENTENCES, least_words: int = WORDS) -> DataFrame:
    """key, n_removed (sentences), text (what remains) for each row."""
    spark = documents.sparkSession
    own = documents[key].cast("long")
    source = documents.select(own.alias("key"), F.when(own.isNull(), F.xxhash64(documents[text])).alias("tie"), documents[text].alias("text"))
    path = f"{checkpoint_folder(spark)}/spans-{uuid.uuid4().hex}"
    span_rows(source, sentences, least_words).write.parquet(path)
    lost = checkpointed(_losses(spark.read.parquet(path)))
    delete_folder(spark, path)
    lost = lost.select(F.col("key").alias("_key"), F.col("tie").alias("_tie"), "others")
    joined = source.join(lost, source["key"].eqNullSafe(F.col("_key")) & source["tie"].eqNullSafe(F.col("_tie")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in in_bytes(whole, "text"):
                kept = [
                    (t, 0) if t is None or others is None else remaining(t, set(others), sentences, least_words)
                    for t, others in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
                ]
                left, gone = zip(*kept, strict=True)
                yield pa.record_batch([batch.column(0), pa.array(gone, pa.int64()), pa.array(left, pa.string())], names=["key", "n_removed", "text"])

    cut = joined.select("key", "text", "others").mapInArrow(run, "key long, n_removed long, text string")
    return cut.select(F.col("key").alias(key), "n_removed", F.col("text").alias(text))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))
