"""Registered queries: each pairs a Spark job over the given tables with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a job under ``name``; ``sql`` is its counterpart on the same tables."""

    def add(run: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, run, sql)
        return run

    return add


def all_queries() -> dict[str, Query]:
    from importlib import import_module

    for module in MODULES:
        import_module(f"fleetlens.queries.{module}")
    return REGISTRY


MODULES = ("series", "measurements", "documents", "fleet", "governance", "streams")
