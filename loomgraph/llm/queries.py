"""All queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from loomgraph.llm import corpus_queries, docpair_queries, handwritten_queries, reading_queries, sampling_queries, syntax_queries

_PARTS = [handwritten_queries, sampling_queries, docpair_queries, syntax_queries, corpus_queries, reading_queries]

QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
