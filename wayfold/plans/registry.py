"""Queries by operator, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfold.plans import attribute_queries, graph_queries, layer_queries, network_queries, tag_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**tag_queries.QUERIES, **graph_queries.QUERIES, **network_queries.QUERIES, **attribute_queries.QUERIES, **layer_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**tag_queries.ORACLE_SQL, **graph_queries.ORACLE_SQL, **network_queries.ORACLE_SQL, **attribute_queries.ORACLE_SQL, **layer_queries.ORACLE_SQL}
