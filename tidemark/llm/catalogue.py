"""All queries of the subpackage, by name."""

from __future__ import annotations

import importlib

_MODULES = ("copies", "runs", "terms", "lookalikes", "packing", "leaks", "truncation", "abuse")


def _all(attr: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= getattr(importlib.import_module(f"tidemark.llm.{m}"), attr)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
