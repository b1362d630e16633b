"""Registered queries: one per operator, run over the supplied tables, with SQL checks where SQL can express them."""

import importlib

MODULES = ("loading", "tables", "posthoc", "models")


def registry() -> dict:
    from platelens.catalog.base import QUERIES

    for m in MODULES:
        importlib.import_module(f"platelens.catalog.{m}")
    return QUERIES
