"""Queries over the test tables and the SQL that must give the same rows."""

from __future__ import annotations

from . import analytics, domain, feeds, markets, quality, study

_PARTS = (analytics, domain, feeds, markets, quality, study)
QUERIES: dict = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
