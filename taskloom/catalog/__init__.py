"""Registered queries and the SQL that checks them, one module per family."""

from importlib import import_module

MODULES = ["vectors", "texts", "trees", "syncing", "costs", "searching", "jobs"]


def _merged(attribute: str) -> dict:
    out = {}
    for m in MODULES:
        part = getattr(import_module(f"taskloom.catalog.{m}"), attribute)
        twice = set(out) & set(part)
        if twice:
            raise ValueError(f"registered twice: {sorted(twice)}")
        out.update(part)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLES")
