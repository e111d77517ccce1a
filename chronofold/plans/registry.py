"""Every registered query of the core engine and its DuckDB equivalent."""

from __future__ import annotations

from . import check_queries, ledger_queries, queries, read_queries, write_queries  # noqa: F401

QUERIES: dict = dict(queries.QUERIES)
ORACLE_SQL: dict[str, str] = dict(queries.ORACLE_SQL)
