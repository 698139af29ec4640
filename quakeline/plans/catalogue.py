"""Registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quakeline.plans import graph_queries, growth_queries, record_queries, return_queries, series_queries, text_queries

_PARTS = (graph_queries, record_queries, series_queries, return_queries, text_queries, growth_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: q for p in _PARTS for k, q in p.ORACLE_SQL.items()}
