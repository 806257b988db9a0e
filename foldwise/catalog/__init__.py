"""Registry of named queries over the driver tables, each paired (where SQL
can express it) with an equivalent DuckDB SQL text used as the oracle."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _load_all():
    from . import (core, scalars, selection, encoding, folds, fitting,  # noqa: F401
                   profiles, blending, scoring, trees, training, ingest)


def queries() -> dict[str, Callable]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLE)
