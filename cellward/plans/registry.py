"""Named queries: ``fn(spark, sf_dir) -> DataFrame`` and, where SQL can say it, a SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_TWINS: dict[str, str] = {}
_MODULES = ("cohorts", "characters", "vocabularies", "log_rules", "log_audit")


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _TWINS[name] = sql
        return fn

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for module in _MODULES:
        import_module(f"cellward.plans.{module}")
    return dict(_QUERIES), dict(_TWINS)
