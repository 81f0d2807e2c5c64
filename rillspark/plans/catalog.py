"""All registered queries by name, with the DuckDB statement of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillspark.plans import algorithm_queries, forecast_queries, front_queries, graph_queries, intake_queries, join_queries, linking_queries, passage_queries, record_queries, relation_queries, rule_queries, series_queries, site_queries, state_queries, stream_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for _module in (series_queries, relation_queries, algorithm_queries, text_queries, intake_queries, site_queries, record_queries, graph_queries, join_queries, passage_queries, forecast_queries, state_queries, linking_queries, front_queries, stream_queries, rule_queries):
    QUERIES |= _module.BOOK.queries
    ORACLE |= _module.BOOK.oracle
