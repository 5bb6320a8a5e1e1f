"""Registered queries with the SQL each one is checked against."""

from __future__ import annotations

from panelwright.suite import books, definitions, evaluation, learning, tables, windows
from panelwright.suite.base import Check


def all_checks() -> dict[str, Check]:
    out: dict[str, Check] = {}
    for module in (windows, evaluation, books, definitions, tables, learning):
        for name, check in module.CHECKS.items():
            if name in out:
                raise ValueError(f"duplicate query {name}")
            out[name] = check
    return out
