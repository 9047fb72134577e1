"""Queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from . import p1, p2, p4, p5, p6, p7, p8

MODULES = [p1, p2, p4, p5, p6, p7, p8]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict:
    return {name: sql.strip() for module in MODULES for name, sql in module.ORACLES.items()}
