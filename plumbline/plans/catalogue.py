"""All queries of the core by name, and the SQL each is compared with."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "violation_report"

_BUILDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a builder (spark, folder) under `name`, with the SQL of the same result where SQL can say it."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        if name in _BUILDERS:
            raise ValueError(f"{name} is registered twice")
        _BUILDERS[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return put


_FAMILIES = ("reporting", "texts", "verification", "mining", "known", "retrieval", "graphs", "states")


def _load() -> None:
    for family in _FAMILIES:
        importlib.import_module(f"plumbline.plans.{family}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_BUILDERS)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
