"""All queries of the evaluation operators by name, and the SQL that each must equal."""

from __future__ import annotations

from plumbline.plans import build_queries, file_queries, flow_queries, metric_queries, model_queries, python_queries, relation_queries, release_queries, text_queries

MODULES = (metric_queries, relation_queries, text_queries, build_queries, flow_queries, release_queries, file_queries, python_queries, model_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
