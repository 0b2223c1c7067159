"""All registered queries."""

import importlib

from checks.registry import ORACLE, QUERIES

for _module in ["detection", "lifecycle", "projects", "texts", "streams"]:
    importlib.import_module(f"checks.{_module}")

__all__ = ["ORACLE", "QUERIES"]
