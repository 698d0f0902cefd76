"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller
writes it as Parquet and reads it again as the next stage's ``docs``.

Cases: null and empty texts, and those without a letter (digits, signs), have
no language and leave with the first stage.  Rows that share an id are told
apart by their texts; equal texts are near-duplicates of each other, whatever
their ids, and the row with the least id stays (a null id only where no other
is).  Texts whose SimHash differs in more than two bits (three-word shingles, as
the operator has it) stay: of the near copies planted in the check tables about
half are that near.  Long texts are read whole, other columns are kept by all
stages but the last, and an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import decontamination, language_id, secret_scans, sentencepiece_codec, simhash_dedup
from wayfold.llm.common import checkpoint_folder, delete_folder, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those that it rejects go."""
    return language_id.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash_dedup.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    return secret_scans.redact_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and digests of every document."""
    encoded = sentencepiece_codec.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), ids_out=True)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("language_id", language),
    ("simhash_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scans", secrets),
    ("sentencepiece", encode),
]

#: The stages train models and link by graph search: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``, each written and read again; only the last one's folder stays."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # its rows are in the new folder now
            delete_folder(spark, before)
        before = path
    return docs
