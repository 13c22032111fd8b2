"""All queries of the core, by name."""

from __future__ import annotations

import importlib

FLAGSHIP = "weighted_hard"
_MODULES = ("data_problems", "pipelines", "corpus_queries", "more_queries", "report_queries")


def _all(attr: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= getattr(importlib.import_module(f"tidemark.plans.{m}"), attr)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
