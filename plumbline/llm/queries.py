"""All queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import queries_corpus, queries_models, queries_native, queries_pages, queries_tables

QUERIES = {**queries_native.QUERIES, **queries_corpus.QUERIES, **queries_pages.QUERIES, **queries_models.QUERIES, **queries_tables.QUERIES}
SQL = {**queries_native.SQL, **queries_pages.SQL, **queries_tables.SQL}
