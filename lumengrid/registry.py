"""Registered queries of the library and the SQL they are checked against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules whose import registers queries.
MODULES = ("words", "joining", "grouping", "ranking", "inference", "sampling", "models", "vectors", "decoding", "cleaning", "permuting", "exchange", "linear", "conditions", "testing", "mixing", "deciding", "geometries", "encodings", "reliabilities", "sweeping", "balancing")

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with equivalent DuckDB SQL where there is any."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"lumengrid.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
