"""The registry: every query of the core with its SQL form, by area."""

from __future__ import annotations

from importlib import import_module

AREAS = ("catalogue", "texts", "search", "trees", "sheets", "feeds")


def queries() -> dict:
    out: dict = {}
    for area in AREAS:
        out |= import_module(f"docketry.plans.{area}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for area in AREAS:
        out |= import_module(f"docketry.plans.{area}").SQL
    return out
