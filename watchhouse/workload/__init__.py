"""Registered queries: every operator run on the given tables, with DuckDB SQL to check against."""

from importlib import import_module

_MODULES = ("rules", "reports", "maintenance", "normalise", "files", "streams")


def queries() -> dict:
    """Load all query modules and return the registry."""
    for name in _MODULES:
        import_module(f"watchhouse.workload.{name}")
    return import_module("watchhouse.workload.registry").QUERIES
