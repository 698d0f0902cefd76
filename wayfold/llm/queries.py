"""The subpackage's registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import (
    decontamination,
    language_id,
    secret_scans,
    sentencepiece_codec,
    simhash_dedup,
    substring_dedup,
    token_counts,
    topk_search,
    toxicity,
    url_filters,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": url_filters.op1,
    "op2_topk_search": topk_search.op2,
    "op3_token_counts": token_counts.op3,
    "op4_toxicity": toxicity.op4,
    "op5_benchmark_decontamination": decontamination.op5,
    "op6_sentencepiece_codec": sentencepiece_codec.op6,
    "op7_secret_scans": secret_scans.op7,
    "op8_substring_dedup": substring_dedup.op8,
    "op9_language_id": language_id.op9,
    "op10_simhash_dedup": simhash_dedup.op10,
}

#: Operators 3, 4, 6, 7, 8, 9 and 10 need libraries, trained models or graph search.
ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": url_filters.SQL,
    "op2_topk_search": topk_search.SQL,
    "op5_benchmark_decontamination": decontamination.SQL,
}
