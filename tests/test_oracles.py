"""Every named query against its SQL on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from creditloom.plans import catalog
from tests.conftest import SMALL

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=lambda row: [repr(v) for v in row])


def _same(left, right):
    if isinstance(left, float) and isinstance(right, float):
        return math.isclose(left, right, rel_tol=1e-9, abs_tol=1e-9)
    return left == right


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    own = set(catalog.queries())  # with or without the text queries
    assert own <= set(QUERIES)
    assert own - set(ORACLES) == {"train_default_model", "platt_fit", "customer_credit_scores_trained"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, connection, name):
    df = QUERIES[name](spark, SMALL)
    got = _sorted(df.columns, df.collect())
    cursor = connection.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = _sorted(columns, cursor.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert len(got) == len(want)
    assert got or name == "rejected_events"  # every customer is known at this scale
    for left, right in zip(got, want, strict=True):
        assert all(map(_same, left, right)), (left, right)


def test_trained_queries_give_a_row_per_customer(spark):
    customers = QUERIES["customer_credit_features"](spark, SMALL).count()
    assert QUERIES["train_default_model"](spark, SMALL).where("raw_probability BETWEEN 0 AND 1").count() == customers
    scores = QUERIES["customer_credit_scores_trained"](spark, SMALL)
    assert scores.where("credit_score BETWEEN 300 AND 850").count() == customers
    assert QUERIES["platt_fit"](spark, SMALL).where("slope > 0").count() == 1


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 150
