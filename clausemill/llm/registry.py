"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("p01_scans", "p02_markup", "p03_canonical", "p04_frequency", "p05_distinctive", "p06_lookalikes", "p07_split", "p08_leakage", "p09_mixing", "p10_repetition")


def queries() -> dict:
    """Every pN_ query by name."""
    return {name: f for module in MODULES for name, f in import_module(f"clausemill.llm.{module}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those queries that SQL can express."""
    return {name: sql for module in MODULES for name, sql in import_module(f"clausemill.llm.{module}").ORACLES.items()}
