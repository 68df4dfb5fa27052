"""All queries of the core, by name."""

from __future__ import annotations

from lodespark.plans import core_queries, retrieval_queries, retrieval_sql

QUERIES = {**retrieval_queries.QUERIES, **core_queries.QUERIES}
SQL = {**retrieval_sql.SQL, **core_queries.SQL}
FLAGSHIP = retrieval_queries.n6_associative
