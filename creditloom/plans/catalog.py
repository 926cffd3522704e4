"""Every operator as a named query over a folder of test tables, with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from creditloom.plans import (  # noqa: F401
    layer_queries,
    live_queries,
    score_queries,
    serving_queries,
    training_queries,
    view_queries,
)
from creditloom.plans.lake import Lake
from creditloom.plans.oracle import with_views
from creditloom.plans.registry import ORACLES, QUERIES

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        name: (lambda spark, sf_dir, build=build: build(Lake(spark, sf_dir))) for name, build in QUERIES.items()
    }


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in ORACLES.items()}
