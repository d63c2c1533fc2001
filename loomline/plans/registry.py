"""All queries of the core library with their checking SQL."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("evaluation", "statistics", "textual", "retrieval", "customers", "streams", "connectors", "kernels", "modelling", "rows", "intervals", "lexical", "indexing", "grouped", "purchase", "reading", "running")


def _gather(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"loomline.plans.{name}"), what, {})
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLE")
