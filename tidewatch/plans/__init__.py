"""Registered queries over the provided tables, each with its SQL twin."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLES, QUERIES

for _name in ("core", "scoring", "indices", "joins", "graph", "texts", "streams", "exports", "merges", "clusters", "threads", "documents"):
    import_module(f"{__name__}.{_name}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
