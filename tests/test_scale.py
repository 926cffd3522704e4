"""Plans and hot keys: what has to hold when one customer owns a third of all rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from creditloom.operators import features, serving, views
from creditloom.operators.running import running
from creditloom.plans import lake as lakes
from creditloom.schemas import TRANSACTIONS
from tests.conftest import SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_cross_joins(spark, name):
    text = plan(entry.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "PythonUDF" not in text and "MapInPandas" not in text


def test_features_hash_instead_of_sorting_all_rows(lake):
    df = features.customer_credit_features(
        lake.table("customers"), lake.table("loans"), lake.table("transactions"), lake.as_of, unique_ids=True
    )
    text = plan(df)
    stacked = text[text.index("HashAggregate") : text.index("Union")]
    assert "SortAggregate" not in stacked
    # one shuffle by customer and account, one by customer, one for the tenants
    assert text.count("Exchange hashpartitioning") == 3


def test_scan_reads_only_what_it_needs(lake):
    text = plan(features.payment_aggregates(lake.table("transactions")))
    assert "EqualTo(transaction_type,LOAN_PAYMENT)" in text
    schema = text[text.index("ReadSchema") :]
    assert "amount" not in schema and "reference_id" not in schema


def test_top_n_is_cut_before_the_shuffle(lake):
    text = plan(serving.recent_transactions(lake.table("transactions"), 5))
    assert "Partial" in text and text.count("WindowGroupLimit") == 4


def hot_rows(n: int = 3000):
    """A third of the rows for customer 0, the rest spread over many."""
    generator = random.Random(1)
    values = []
    for i in range(n):
        customer = 0 if i % 3 == 0 else generator.randint(1, n // 10)
        values.append((customer, i, float(generator.randint(-50, 50)), f"id{i:06d}"))
    generator.shuffle(values)
    return values


@pytest.fixture
def many_partitions(spark):
    """Small data would be merged into one partition."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_running_totals_of_a_hot_key_span_partitions(spark, many_partitions):
    values = hot_rows()
    df = spark.createDataFrame(values, "k int, t int, v double, id string").repartition(7)
    df = df.withColumns({"s": F.col("v"), "hi": F.col("v"), "lo": F.col("v")})
    got = {
        r["id"]: (r["s"], r["hi"], r["lo"]) for r in running(df, ["k"], ["t", "id"], ["s"], ["hi"], ["lo"]).collect()
    }
    want, seen = {}, {}
    for k, _, v, key in sorted(values, key=lambda row: (row[0], row[1], row[3])):
        total, high, low = seen.get(k, (0.0, v, v))
        seen[k] = (total + v, max(high, v), min(low, v))
        want[key] = seen[k]
    assert got == want
    parts = df.repartitionByRange("k", "t", "id").where("k = 0").select(F.spark_partition_id()).distinct().count()
    assert parts > 1


def test_running_totals_without_a_key(spark, many_partitions):
    df = spark.range(1000).select(F.col("id").alias("t"), F.lit(1).cast("long").alias("n")).repartition(6)
    got = {r["t"]: r["n"] for r in running(df, [], ["t"], ["n"]).collect()}
    assert got == {t: t + 1 for t in range(1000)}


def test_recent_transactions_of_a_hot_customer(spark):
    rows = [
        (f"t{i:05d}", 0 if i % 3 == 0 else i, "t", "s", "LOAN_PAYMENT", None, 1.0, 1.0, 0.0, "LATE", "r", 1, None)
        for i in range(6000)
    ]
    recent = serving.recent_transactions(spark.createDataFrame(rows, TRANSACTIONS).repartition(9))
    hot = [r["transaction_id"] for r in recent.where("customer_id = 0").orderBy("rank").collect()]
    assert hot == [f"t{i:05d}" for i in range(5997, -1, -3)]
    summary = serving.transaction_summary(recent).where("customer_id = 0").first()
    assert (summary["total_transactions"], summary["late_or_past_due_events"]) == (2000, 2000)
    pages = views.transactions_page(recent, page=100, page_size=20).where("customer_id = 0")
    assert [r["transaction_id"] for r in pages.orderBy("place").collect()] == hot[1980:]


def test_checkpoint_folder_comes_from_the_session(spark):
    from creditloom.session import fresh_path, shared_dir

    folder = shared_dir(spark)
    assert fresh_path(spark, "x").startswith(folder.rstrip("/"))
    assert spark.sparkContext.getCheckpointDir() is not None


def test_features_read_layers_that_are_published(spark, monkeypatch):
    """Once the layers are written, the raw files are not parsed a second time for the features; without them all is composed."""
    monkeypatch.setattr(lakes, "_published", {})
    own = lakes.Lake(spark, SMALL)
    composed = own.features()
    assert "get_json" in plan(composed) or "from_json" in plan(composed)
    own.table("profile"), own.table("loans"), own.table("transactions")
    read = own.features()
    assert "from_json" not in plan(read) and "get_json" not in plan(read) and "lineitem" not in plan(read)
    assert read.exceptAll(composed).count() == 0 and read.count() == composed.count()


@pytest.mark.parametrize("name", ["feature_trail", "upsert_by_key", "top_active_customer", "what_if_scores"])
def test_queries_publish_the_layers_before_the_features(spark, monkeypatch, name):
    monkeypatch.setattr(lakes, "_published", {})
    monkeypatch.setattr(lakes, "_bucketed", {})
    entry.queries()[name](spark, SMALL)
    made = [key[-1] for key in lakes._published]
    assert made.index("transactions") < made.index("features")


def test_features_deal_rows_by_account_before_they_aggregate_them(lake):
    """Else every task that reads rows holds the measures of all customers it meets, as many as rows in the end."""
    tables = [lake.table(name) for name in ("customers", "loans", "transactions")]
    for mode in features.MODES:
        text = plan(features.customer_credit_features(*tables, lake.as_of, mode=mode, unique_ids=True))
        below = text[: text.index("Union")]
        assert below.rindex("REPARTITION_BY_NUM") > below.rindex("HashAggregate")


@pytest.mark.parametrize("unique_ids", [True, False])
def test_only_accounts_are_counted_as_accounts(spark, unique_ids):
    accounts = [None, "0", "1", "=0", "1", None, "", "0"]
    rows = [(f"b{i}", 1, "BALANCE_SNAPSHOT", account) for i, account in enumerate(accounts)]
    rows += [(f"p{i}", 1 + i % 2, "LOAN_PAYMENT", "0") for i in range(40)]
    rows += [("b90", 3, "BALANCE_SNAPSHOT", "7"), ("b91", 4, "BALANCE_SNAPSHOT", None)]
    schema = ", ".join(f.strip() for f in TRANSACTIONS.split(","))
    names = [f.split()[0] for f in TRANSACTIONS.split(",")]
    given = ("transaction_id", "customer_id", "transaction_type", "reference_id")
    df = spark.createDataFrame([tuple(dict(zip(given, r)).get(n) for n in names) for r in rows], schema)
    loans = spark.createDataFrame(
        [("l1", 5)], "loan_id string, customer_id long"
    ).selectExpr("*", "'t0' institution_id", "'s' source_system", "'Active' loan_status", "0 days_past_due", "1.0D loan_amount", "0 default_flag")
    people = spark.createDataFrame([(k, "t0", "s", 1.0) for k in range(1, 7)], "customer_id long, institution_id string, source_system string, income double")
    for mode, first in (("offline", 4), ("online", 3)):
        found = features.customer_measures(people, loans, df, mode, unique_ids)
        got = {r["customer_id"]: (r["total_accounts"], r["total_payments"]) for r in found.collect()}
        assert got == {1: (first, 20), 2: (0, 20), 3: (1, 0), 4: (0, 0), 5: (0, 0), 6: (None, None)}
