"""All registered queries and their SQL, by name."""

from __future__ import annotations

from .plans import indexes, more, queries  # noqa: F401

QUERIES: dict = dict(queries.QUERIES)
ORACLE_SQL: dict = dict(queries.ORACLE_SQL)
