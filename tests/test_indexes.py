"""Indexes and bucketed tables against the same results without them, and what their plans leave out."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from creditloom.operators import serving, state, views
from creditloom.plans import lake as lakes
from creditloom.plans import serving_queries, view_queries
from creditloom.schemas import TRANSACTIONS
from creditloom.session import fresh_path
from creditloom.sources.files import write_bucketed
from tests.conftest import SMALL


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def as_list(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


@pytest.fixture(scope="module")
def recent(spark):
    """One customer with 20 000 transactions and many equal amounts, some with a few, one undated."""
    rng = random.Random(4)
    rows = []
    for i in range(20_000):
        rows.append((f"t{i:05d}", 1, rng.choice(["LOAN_PAYMENT", "BALANCE_SNAPSHOT"]), rng.randrange(900), rng.choice([None, 5.0, 7.5, rng.random()])))
    rows += [(f"u{i}", 2 + i % 3, "LOAN_PAYMENT", i, float(i % 4)) for i in range(70)]
    rows += [("v", 9, "LOAN_PAYMENT", None, None)]
    made = spark.createDataFrame(rows, "transaction_id string, customer_id long, transaction_type string, day int, amount double")
    dated = made.withColumn("transaction_date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("day")))
    columns = [c.strip().split() for c in TRANSACTIONS.split(",")]
    full = dated.select(*[F.col(n) if n in dated.columns else F.lit(None).cast(t).alias(n) for n, t in columns])
    path = fresh_path(spark, "test-recent")
    serving.recent_transactions(full).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize(("sort_by", "descending", "kind"), [
    ("amount", False, None), ("amount", True, "LOAN_PAYMENT"), ("transaction_date", True, None), ("activity", False, None),
])
def test_a_page_by_index_is_the_sorted_one(spark, recent, sort_by, descending, kind):
    path = fresh_path(spark, "test-index")
    views.page_index(recent, sort_by, descending, kind).write.parquet(path)
    index = spark.read.parquet(path)
    for page in (1, 3, 1000):
        want = views.transactions_page(recent, kind, sort_by, descending, page)
        got = views.indexed_page(recent, index, sort_by, descending, kind, page)
        columns = ["customer_id", "transaction_id", "place", "page", "pages"]
        assert as_list(got.select(columns)) == as_list(want.select(columns))


def test_a_late_page_sorts_one_range(spark, recent):
    path = fresh_path(spark, "test-index")
    views.page_index(recent, "amount", False).write.parquet(path)
    page = views.indexed_page(recent, spark.read.parquet(path), "amount", False, page=1000)
    rows = page.where("customer_id = 1")
    assert rows.count() == 20 and rows.agg(F.min("place")).first()[0] == 19_981
    plan = plan_of(page)
    assert "rangepartitioning" not in plan
    # the transactions themselves move once at most; the index is aggregated apart
    assert sum("Exchange" in line for line in plan.splitlines()) <= 3


@pytest.mark.parametrize(("sort_by", "descending", "kind"), [
    ("amount", False, None), ("amount", True, "LOAN_PAYMENT"), ("transaction_date", True, None), ("activity", False, None),
])
def test_an_early_page_is_the_sorted_one(spark, recent, sort_by, descending, kind):
    columns = ["customer_id", "transaction_id", "place", "page", "pages"]
    for page in (1, 2, 9):
        want = views.transactions_page(recent, kind, sort_by, descending, page).select(columns)
        got = views.early_page(recent.drop("rank"), kind, sort_by, descending, page, more=[])
        assert as_list(got.select(columns)) == as_list(want)
        assert "WindowGroupLimit" in plan_of(got)


def test_a_page_and_a_summary_write_no_more_than_they_read_twice(spark, monkeypatch):
    """The page by amount needs neither ranks nor an index; the summary, one pass over the transactions, writes no layer."""
    monkeypatch.setattr(lakes, "_published", {})
    own = lakes.Lake(spark, SMALL)
    serving_queries.transaction_summary(own).collect()
    assert not lakes._published
    view_queries.transactions_page(own).collect()
    assert {key[-1] for key in lakes._published} == {"transactions"}


def test_search_by_grams_equals_a_scan(spark, lake):
    profiles, scores, features = (lake.table(n) for n in ("profile", "scores", "features"))
    rows = write_bucketed(serving.search_rows(profiles, scores, features), fresh_path(spark, "test-search"), "rows", ["customer_id"], 4)
    path = fresh_path(spark, "test-grams")
    serving.search_grams(rows).write.parquet(path)
    grams = spark.read.parquet(path)
    for text in (" 7 ", "12", "123", "1234", "11", "111", "9", None, "", "x", "1x"):
        want = serving.search_customers(profiles, scores, text, 30, features)
        assert serving.search_indexed(rows, grams, text, 30).collect() == want.collect()
    plan = plan_of(serving.search_indexed(rows, grams, "12", 30))
    assert "PushedFilters: [EqualTo(gram,12)" in plan or "PushedFilters: [In(gram" in plan or "gram" in plan.split("PushedFilters")[1]
    assert profiles.inputFiles()[0].rsplit("/", 1)[0] not in plan


def test_stored_state_stays_where_it_is(spark, lake, monkeypatch):
    """No Exchange above the scans of state and accounts, also where nothing is small enough to be broadcast."""
    events, root = lake.event_transactions(), fresh_path(spark, "test-state")
    held = write_bucketed(lake.table("state"), root, "state", ["customer_id"], 4)
    accounts = write_bucketed(lake.table("accounts"), root, "accounts", ["customer_id", "reference_id"], 4)
    scenarios = events.withColumnRenamed("transaction_id", "scenario_id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        asked = state.what_if_measures(scenarios, held, accounts)
        assert exchanges_above_scans(plan_of(asked), ["default.state_", "default.accounts_"]) == [False, False]
        plain = state.what_if_measures(scenarios, lake.table("state"), lake.table("accounts"))
        schemas = ["struct<customer_id:bigint,reference_id:string>", "source_system:string,income:double,total_loans"]
        assert exchanges_above_scans(plan_of(plain), schemas) == [True, True]
        trail = state.trail_measures(events, held, accounts)
        assert not any(exchanges_above_scans(plan_of(trail), ["default.state_", "default.accounts_"]))
        assert as_list(asked) == as_list(plain)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanges_above_scans(plan: str, marks: list[str]) -> list[bool]:
    """For every scan with one of ``marks``: whether an Exchange lies between it and the next join above."""
    found = []
    lines = plan.splitlines()
    for at, line in enumerate(lines):
        if "FileScan" in line and any(m in line for m in marks):
            depth, moved = len(line) - len(line.lstrip(" :+-*")), False
            for above in reversed(lines[:at]):
                own = len(above) - len(above.lstrip(" :+-*"))
                if own >= depth:
                    continue
                depth = own
                if "Join" in above:
                    break
                moved |= "Exchange" in above
            found.append(moved)
    return found
