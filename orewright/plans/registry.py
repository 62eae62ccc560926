"""All queries outside the llm subpackage, gathered from the modules of this package."""

from __future__ import annotations

import importlib

#: Modules with QUERIES (name -> callable) and SQL (name -> DuckDB SQL).
MODULES = ("general", "textual", "scanning", "searching", "functional", "structural", "relations", "streamed", "extended", "symbols")


def _all(what: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(getattr(importlib.import_module(f"orewright.plans.{m}"), what))
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")
