"""Registers a function over a lake as a named query, with or without SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from creditloom.plans.lake import Lake

QUERIES: dict[str, Callable[[Lake], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(build: Callable[[Lake], DataFrame]):
        key = name or build.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = build
        if sql is not None:
            ORACLES[key] = sql
        return build

    return register
