"""Queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations


def _load():
    from workload import registry

    for module in ("views", "feed_ops", "values", "schemas", "figures"):
        __import__(f"workload.{module}")
    return registry


def all_queries() -> dict:
    return dict(_load().QUERIES)


def all_sql() -> dict[str, str]:
    return dict(_load().SQL)
