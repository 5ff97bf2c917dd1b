"""Queries of the core and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("codes", "lexical", "sections", "graph", "vectors", "search", "support", "metrics", "audit", "extra", "answers", "checks", "records")


def queries() -> dict:
    """Every query by name."""
    return {name: f for module in MODULES for name, f in import_module(f"clausemill.plans.{module}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those queries that SQL can express."""
    return {name: sql for module in MODULES for name, sql in import_module(f"clausemill.plans.{module}").ORACLES.items()}
