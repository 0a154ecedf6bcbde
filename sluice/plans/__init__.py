"""The registered queries and their SQL counterparts."""

from __future__ import annotations

from importlib import import_module

from .fixtures import Inputs, with_fixtures

SECTIONS = ("sources", "rows", "writes", "alignment", "template_queries", "lookups", "monitoring", "sql_classes")


def _collect(attribute: str) -> dict:
    found: dict = {}
    for section in SECTIONS:
        found.update(getattr(import_module(f"{__name__}.{section}"), attribute))
    return found


def queries() -> dict:
    """Name to ``(spark, folder) -> DataFrame``."""
    return {name: (lambda spark, folder, fn=fn: fn(Inputs(spark, folder))) for name, fn in _collect("QUERIES").items()}


def oracle_sql() -> dict[str, str]:
    """Name to the SQL text that gives the same rows on the given tables."""
    return {name: with_fixtures(text) for name, text in _collect("ORACLES").items()}
