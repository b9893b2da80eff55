"""Registered queries: each runs over the given tables, most with an equivalent SQL text."""

from __future__ import annotations

import importlib

from docloom.catalog.registered import ORACLES, QUERIES

FAMILIES = ("content", "chunks", "prose", "code", "entities", "graph", "search", "reports", "writes", "streams")


def load_all() -> tuple[dict, dict]:
    for family in FAMILIES:
        importlib.import_module(f"docloom.catalog.{family}")
    return QUERIES, ORACLES
