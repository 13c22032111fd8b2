import importlib
import sys

import pytest


@pytest.mark.parametrize("missing", ["tidemark.llm", "ahocorasick", "sentencepiece", "regex"])
def test_core_stands_alone(monkeypatch, missing):
    """Without the optional subpackage, or without a library that only it needs, the queries of the core are all there."""
    from tidemark.plans import catalogue

    root = str(importlib.import_module("pathlib").Path(__file__).parents[1])
    monkeypatch.syspath_prepend(root)
    for name in [m for m in sys.modules if m.startswith("tidemark.llm") or m == "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    entry = importlib.import_module("__spark_entry__")
    assert set(catalogue.queries()) <= set(entry.queries()) and set(catalogue.oracle_sql()) <= set(entry.oracle_sql())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_core_imports_no_optional_part():
    import pathlib

    root = pathlib.Path(__file__).parents[1] / "tidemark"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "tidemark.llm" not in f.read_text(encoding="utf-8"), f
