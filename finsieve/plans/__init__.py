"""Derived tables, queries over them, and their SQL counterparts."""

import importlib

from finsieve.plans.registry import ORACLES, QUERIES

for _module in ("ingest", "feature", "audit", "ranking", "sampling", "run", "model"):
    importlib.import_module(f"finsieve.plans.{_module}_queries")

__all__ = ["ORACLES", "QUERIES"]
