"""The entry point without the text operators."""

from __future__ import annotations

import importlib

import __spark_entry__ as entry


def test_a_missing_dependency_hides_the_text_operators_only(monkeypatch):
    real = importlib.import_module

    def missing(name, *args):
        if name.startswith("streetbook.llm"):
            raise ImportError(name)
        return real(name, *args)

    monkeypatch.setattr(importlib, "import_module", missing)
    assert "e01_upsert_overwrite" in entry.queries() and not [q for q in entry.queries() if q.startswith("op") or q == "pipeline"]
    assert "e01_upsert_overwrite" in entry.oracle_sql()
