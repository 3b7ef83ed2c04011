"""The queries of this engine over the driver tables, and the SQL that must agree with them."""

from __future__ import annotations

from importlib import import_module

MODULES = ["plans.report", "plans.aggregates", "plans.meshes", "plans.elements", "plans.graphs", "plans.clouds", "plans.sets", "plans.fields"]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in import_module(f"{__package__}.{m}").SQL.items()}
