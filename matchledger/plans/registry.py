"""Queries by name, and the SQL that each is held against."""

from __future__ import annotations

from . import archive_queries, match_queries, publication_queries, record_queries, relation_queries, review_queries, scan_queries, source_queries, tree_queries

DEFINED = {**archive_queries.DEFINED, **match_queries.DEFINED, **publication_queries.DEFINED, **record_queries.DEFINED, **relation_queries.DEFINED, **review_queries.DEFINED, **scan_queries.DEFINED, **source_queries.DEFINED, **tree_queries.DEFINED}
QUERIES = {name: query for name, (query, _) in DEFINED.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in DEFINED.items() if sql}
