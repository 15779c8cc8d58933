"""Compositions of the operators: whole flows, measured runs, and the registered queries."""

from __future__ import annotations

from .catalog import QUERIES, SQL, Query


def _load() -> None:
    from . import queries_hash, queries_sketch, queries_source, queries_stream  # noqa: F401


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
