"""All registered queries and their SQL twins."""

from __future__ import annotations

from quillon.plans import feature_queries, oracles, queries, reply_queries

QUERIES = queries.QUERIES | feature_queries.QUERIES | reply_queries.QUERIES
ORACLE_SQL = oracles.ORACLE_SQL | feature_queries.ORACLE_SQL | reply_queries.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
