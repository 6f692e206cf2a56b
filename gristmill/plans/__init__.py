"""Queries of the library, by name, and their SQL twins."""

from __future__ import annotations

from gristmill.plans.registry import QUERIES, SQL, Query


def _load() -> None:
    from gristmill.plans import flow_queries, page_queries, report_queries, rule_queries, sql, state_queries, text_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
