"""All queries over the driver's tables, with DuckDB SQL for each that SQL expresses."""

from __future__ import annotations

from ridgeline.plans import curves, judging, learned, more, pairs, ratings, retrieval, search, store

QUERIES = search.QUERIES | ratings.QUERIES | curves.QUERIES | store.QUERIES | more.QUERIES | pairs.QUERIES | retrieval.QUERIES | judging.QUERIES | learned.QUERIES
ORACLE_SQL = search.ORACLE_SQL | ratings.ORACLE_SQL | curves.ORACLE_SQL | store.ORACLE_SQL | more.ORACLE_SQL | pairs.ORACLE_SQL | retrieval.ORACLE_SQL | judging.ORACLE_SQL | learned.ORACLE_SQL
FLAGSHIP = "vector_topk_state_filtered"
