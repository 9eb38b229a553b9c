"""The query catalogue: each entry pairs a DataFrame query with DuckDB SQL for the same rows.

A query module registers with :func:`query`; ``oracle`` is the SQL text, or None where SQL
cannot express the operator (those are tested against brute force).
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = ("graph_queries", "ordered_queries", "retrieval_queries", "evolve_queries", "value_queries", "stream_queries", "codec_queries", "source_queries", "model_queries")
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register ``name`` with its SQL oracle."""

    def register(function: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = function
        if oracle is not None:
            _ORACLES[name] = oracle
        return function

    return register


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"tessera.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
