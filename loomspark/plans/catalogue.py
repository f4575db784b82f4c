"""Registered queries of the engine over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspark.plans import facts_graph, ingest_quality, knowledge_queries, report_queries, retrieval_queries, text_queries, training_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (text_queries, ingest_quality, facts_graph, retrieval_queries, training_queries, report_queries, knowledge_queries):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
