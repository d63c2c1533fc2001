"""Queries of this package and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("language", "markup", "neardup", "splitting", "tokens", "encoding", "packing", "mixing", "repetition")


def _gather(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        try:
            out |= getattr(import_module(f"{__package__}.{name}"), what, {})
        except ModuleNotFoundError as e:
            if e.name != f"{__package__}.{name}":
                raise
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLE")
