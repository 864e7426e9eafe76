"""All registered queries of the engine itself."""

from __future__ import annotations

from . import model_queries, trace_queries

QUERIES = trace_queries.QUERIES | model_queries.QUERIES
SQL = trace_queries.SQL | model_queries.SQL
