"""Registered queries of the engine's own operators and their SQL."""

from . import index_queries, ledger_queries, page_queries, search_queries, verbosity_queries

_PARTS = (search_queries, index_queries, page_queries, verbosity_queries, ledger_queries)
QUERIES = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
SQL = {k: q for part in _PARTS for k, q in part.SQL.items()}
