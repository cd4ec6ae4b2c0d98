"""All queries of the library with their SQL counterparts."""

from __future__ import annotations

from tidewatch.plans import dataset_queries, evaluation_queries, feed_queries, graph_queries, report_queries, text_queries, url_queries

MODULES = (url_queries, text_queries, report_queries, evaluation_queries, dataset_queries, graph_queries, feed_queries)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
