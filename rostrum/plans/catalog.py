"""All queries of this library's own domain, with their oracles."""

from __future__ import annotations

from rostrum.plans import merge_queries, rank_queries, readmodel_queries, result_queries, score_queries, source_queries

CATALOGS = [m.CATALOG for m in (score_queries, result_queries, rank_queries, merge_queries, readmodel_queries, source_queries)]
QUERIES = {name: f for c in CATALOGS for name, f in c.queries.items()}
ORACLES = {name: sql for c in CATALOGS for name, sql in c.oracles.items()}
