"""Every core query, with its SQL where SQL can express it."""

from __future__ import annotations

from . import corpus, evaluation, references, sources, streams

MODULES = [evaluation, corpus, references, sources, streams]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict:
    return {name: sql.strip() for module in MODULES for name, sql in module.ORACLES.items()}
