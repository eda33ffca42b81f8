"""All queries of the core library."""

from __future__ import annotations

from spanloom.plans import record_queries, score_queries, segment_queries, store_queries

flagship = store_queries.voted_agreement

QUERIES = record_queries.QUERIES | segment_queries.QUERIES | score_queries.QUERIES | store_queries.QUERIES
ORACLE_SQL = record_queries.ORACLE_SQL | segment_queries.ORACLE_SQL | score_queries.ORACLE_SQL | store_queries.ORACLE_SQL
