"""Streams against batch: micro-batches, replays and parity of the two ways to compute features."""

from __future__ import annotations

import shutil

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from creditloom.operators import state
from creditloom.operators.features import customer_credit_features
from creditloom.plans.lake import CONFIG, model_probability
from creditloom.schemas import FEATURE_COLUMNS, TRANSACTIONS
from creditloom.session import fresh_path
from creditloom.streaming.live import LiveRefresh
from creditloom.streaming.source import EachOnce, event_stream
from creditloom.streaming.versions import BASE, Versions
from tests.conftest import SMALL


def rounded(df):
    return df.selectExpr("customer_id", *[f"round({c}, 6)" for c in FEATURE_COLUMNS])


def as_set(df):
    return {tuple(r) for r in df.collect()}


def prepared(lake, root, **options):
    refresh = LiveRefresh(lake.spark, root, model_probability(), CONFIG, buckets=4, **options)
    return refresh.prepare(
        profiles=lake.table("profile"),
        loans=lake.table("loans"),
        transactions=lake.table("transactions"),
        features=lake.table("features"),
        scores=lake.table("scores"),
        history=lake.table("score_history"),
    )


@pytest.fixture(scope="module")
def split_events(lake, tmp_path_factory):
    """The events in four files, one per week, the last with repeats of the first."""
    folder = tmp_path_factory.mktemp("events")
    events = lake.spark.read.parquet(f"{lake.sf_dir}/events.parquet")
    week = F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3))
    for part in range(4):
        rows = events.where(week == part)
        if part == 3:
            rows = rows.unionByName(rows.limit(20))
        path = str(folder / f"tmp{part}")
        rows.orderBy("ts").coalesce(1).write.parquet(path)
        source = next((folder / f"tmp{part}").glob("*.parquet"))
        shutil.copy(source, folder / f"events-{part}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def live(lake, split_events):
    refresh = prepared(lake, fresh_path(lake.spark, "test-live"))
    stream = event_stream(lake.spark, split_events, "events-*.parquet", max_files=1)
    query = refresh.start(stream, fresh_path(lake.spark, "test-live-checkpoint"))
    query.awaitTermination()
    return refresh


def test_several_batches_ran(live):
    assert live.read("transactions").select("batch_id").distinct().count() == 4


def test_repeated_events_are_stored_once(live, lake):
    stored = live.read("transactions")
    assert stored.count() == stored.select("transaction_id").distinct().count() == lake.event_transactions().count()


def test_batches_together_equal_one_trail(live, lake):
    whole = rounded(state.last_of_trail(state.trail_features(lake.table("trail"))))
    touched = lake.table("trail").select("customer_id").distinct()
    current = rounded(live.current("features").join(touched, "customer_id", "left_semi"))
    assert as_set(current) == as_set(whole)


def test_trail_ends_where_the_batch_features_are(lake):
    events = lake.event_transactions()
    last_day = events.agg(F.max(F.to_date("event_time"))).first()[0]
    history = lake.table("transactions").unionByName(
        events.drop("event_time").withColumn("created_at", F.lit(None).cast("timestamp")).select(
            *lake.table("transactions").columns
        )
    )
    batch = customer_credit_features(lake.table("profile"), lake.table("loans"), history, last_day, "online")
    last = state.last_of_trail(state.trail_features(lake.table("trail")))
    same_day = last.where(F.to_date("event_time") == F.lit(last_day))
    assert same_day.count() > 0
    got = rounded(same_day)
    want = rounded(batch.join(same_day, "customer_id", "left_semi"))
    assert as_set(got) == as_set(want)


def test_history_grows_by_one_row_per_event(live, lake):
    added = live.read("history").where("batch_id >= 0")
    assert added.where("source = 'SIMULATION'").count() == lake.event_transactions().count()
    initial = added.where("source = 'INITIAL'")
    assert initial.count() == initial.select("customer_id").distinct().count()
    before = lake.table("score_history").select("customer_id").distinct()
    assert initial.join(before, "customer_id", "left_semi").count() == 0


def test_score_changes_chain(live):
    changes = live.read("score_changes").collect()
    by_customer = {}
    for row in sorted(changes, key=lambda r: r["batch_id"]):
        earlier = by_customer.get(row["customer_id"])
        if earlier is not None:
            assert row["previous_credit_score"] == earlier
        by_customer[row["customer_id"]] = row["new_credit_score"]
    assert by_customer


def test_replayed_batch_changes_nothing(live, lake):
    tables = ("transactions", "features", "scores", "history", "state", "accounts")
    before = {name: as_set(live.read(name)) for name in tables}
    stored = live.read("bronze_events").where("batch_id = 2")
    ids = stored.select("transaction_id").distinct().checkpoint()
    again = lake.events().join(ids, "transaction_id", "left_semi")
    live.apply(again, 2)
    assert {name: as_set(live.read(name)) for name in tables} == before


def test_merged_parts_change_nothing(live, lake, split_events):
    refresh = prepared(lake, fresh_path(lake.spark, "test-snapshots"), fan=2)
    stream = event_stream(lake.spark, split_events, "events-*.parquet", max_files=1)
    refresh.start(stream, fresh_path(lake.spark, "test-snapshots-checkpoint")).awaitTermination()
    for name in ("features", "scores", "state"):
        assert as_set(refresh.current(name)) == as_set(live.current(name))
    with pytest.raises(ValueError):
        refresh.start(stream, fresh_path(lake.spark, "test-other-checkpoint"))


def test_late_and_invalid_events(lake):
    refresh = prepared(lake, fresh_path(lake.spark, "test-late"))
    events = lake.events().join(lake.known().select("customer_id"), "customer_id", "left_semi").orderBy("event_time").limit(9)
    early, late = events, events
    refresh.apply(late.withColumn("event_time", F.col("event_time") + F.expr("interval 90 days")), 0)
    again = early.withColumn("transaction_id", F.concat("transaction_id", F.lit("-early")))
    odd = early.limit(1).withColumn("transaction_id", F.lit("odd"))
    refund = odd.withColumn("transaction_type", F.lit("REFUND"))
    nothing = odd.withColumns({"transaction_id": F.lit("none"), "amount": F.lit(None).cast("double")})
    endless = odd.withColumns({"transaction_id": F.lit("endless"), "amount": F.lit(float("-inf"))})
    large = odd.withColumns({"transaction_id": F.lit("large"), "expected_amount": F.lit(1e31)})
    nameless = early.limit(2).withColumn("transaction_id", F.lit(None).cast("string"))
    odd_ones = refund.unionByName(nothing).unionByName(endless).unionByName(large).unionByName(nameless)
    refresh.apply(early.unionByName(again).unionByName(again).unionByName(odd_ones), 1)
    assert refresh.read("transactions").count() == 18
    refused = [(r["transaction_id"], r["reason"]) for r in refresh.read("rejected_events").collect()]
    assert sorted(refused, key=str) == [
        ("endless", "amount out of range"),
        ("large", "amount out of range"),
        ("none", "no amount"),
        ("odd", "unknown type"),
        (None, "no id"),
        (None, "no id"),
    ]


def test_a_batch_that_dies_leaves_the_version_before(lake, monkeypatch):
    refresh = prepared(lake, fresh_path(lake.spark, "test-killed"), fan=2)
    events = lake.events().join(lake.known().select("customer_id"), "customer_id", "left_semi").orderBy("event_time").limit(30)
    first, second = events.limit(10).checkpoint(), events.orderBy(F.desc("event_time")).limit(10).checkpoint()
    refresh.apply(first, 0)
    tables = ("transactions", "features", "scores", "history", "state", "accounts", "ids")
    before = {name: as_set(refresh.read(name)) for name in tables}
    from creditloom.streaming import live

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(live, "history_additions", dies)  # nearly everything is written by then
        with pytest.raises(RuntimeError):
            refresh.apply(second, 1)
    assert refresh.store.newest().number == 0
    assert {name: as_set(refresh.read(name)) for name in tables} == before
    refresh.apply(second, 1)
    assert refresh.read("transactions").count() == 20


def test_paths_stay_few_over_two_hundred_batches(spark):
    """Parts are merged by size class and dead ones deleted; every row stays, of current values the newest."""
    store = Versions(spark, fresh_path(spark, "test-versions"), buckets=2, fan=4)
    version = store.begin(BASE)
    version.write(spark.createDataFrame([(0, -1)], "customer_id long, value int").coalesce(1), "rows")
    version.write(spark.createDataFrame([(0, -1)], "customer_id long, value int").coalesce(1), "newest", newest=True)
    version.commit()
    most = folders = 0
    for batch in range(200):
        version = store.begin(batch)
        rows = spark.createDataFrame([(batch % 5, batch)], "customer_id long, value int").coalesce(1)
        version.write(rows, "rows")
        if batch % 10 == 0:
            version.write(rows, "newest", newest=True)
        version.commit()
        now = store.newest()
        most = max(most, len(now.paths(now.tables["rows"].parts)))
        folders = max(folders, len(store.files.names("data/rows")))
    assert most <= 1 + 3 * 4 + 1 and folders <= most + 12 and store.committed() == [197, 198, 199]
    assert {r["value"] for r in store.read("rows").collect()} == set(range(-1, 200)) and store.read("rows").count() == 201
    assert as_set(store.newest().current("newest")) == {(0, 190)}
    with pytest.raises(ValueError):
        store.begin(100)


def test_lookups_are_exact_and_read_little(spark):
    store = Versions(spark, fresh_path(spark, "test-seen"), buckets=4, fan=3)
    store.begin(BASE).commit()
    for batch in range(7):
        version = store.begin(batch)
        version.write(spark.range(batch * 1000, batch * 1000 + 1000).selectExpr("concat('id', id) AS k"), "ids", by="k", filtered=True)
        version.commit()
    version = store.begin(7)
    asked = spark.range(6500, 9000).selectExpr("concat('id', id) AS k", "id")
    assert as_set(version.unseen(asked, "ids").select("id")) == {(i,) for i in range(7000, 9000)}
    none_seen = version.unseen(spark.range(10**6, 10**6 + 50).selectExpr("concat('id', id) AS k"), "ids")
    plan = none_seen._jdf.queryExecution().optimizedPlan().toString()
    assert none_seen.count() == 50 and "Join" not in plan  # no stored key was read
    assert version.unseen(asked.where("false"), "ids").count() == 0


def test_each_event_is_stored_once(spark, tmp_path):
    """Copies in one batch, in later ones and very late ones; nothing is held in the state of the stream."""
    once = EachOnce(Versions(spark, fresh_path(spark, "test-once"), buckets=4, fan=2))
    schema = "transaction_id string, value int, event_time timestamp"
    for batch in range(6):
        rows = [(f"t{i}", i, None) for i in range(batch * 10, batch * 10 + 15)] + [("t0", 0, None), ("t0", 0, None), (None, batch, None)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = once.start(stream, str(tmp_path / "checkpoint"))
    query.awaitTermination()
    assert sorted(r["value"] for r in once.read().collect()) == list(range(65))
    assert once.read("without_id").count() == 6
    assert not any(p["stateOperators"] for p in query.recentProgress)


@pytest.mark.parametrize("together", [True, False])
def test_a_valid_copy_counts_beside_invalid_ones(lake, together):
    """The same events are accepted whether the copies come in one batch or in two."""
    refresh = prepared(lake, fresh_path(lake.spark, "test-copies"))
    valid = lake.events().join(lake.known().select("customer_id"), "customer_id", "left_semi").orderBy("event_time").limit(3)
    nothing = valid.withColumn("amount", F.lit(None).cast("double"))
    unknown = valid.withColumn("transaction_type", F.lit("A_REFUND"))
    stranger = valid.withColumn("customer_id", F.lit(-1).cast("long"))
    invalid = nothing.unionByName(unknown).unionByName(stranger)
    for n, batch in enumerate([invalid.unionByName(valid)] if together else [invalid, valid]):
        refresh.apply(batch, n)
    key = ["transaction_id", "customer_id", "amount"]
    assert as_set(refresh.read("transactions").select(*key)) == as_set(valid.select(*key))


def test_empty_batch_is_a_no_op(lake):
    refresh = prepared(lake, fresh_path(lake.spark, "test-empty"))
    before = as_set(refresh.current("features"))
    refresh.apply(lake.events().where("false"), 0)
    assert as_set(refresh.current("features")) == before


def test_unknown_customers_are_set_aside(lake):
    refresh = prepared(lake, fresh_path(lake.spark, "test-unknown"))
    refresh.apply(lake.events().limit(5).withColumn("customer_id", F.lit(-1).cast("long")), 0)
    assert refresh.read("rejected_events").count() == 5
    assert refresh.read("transactions").count() == 0


def test_what_if_equals_submitting(lake):
    """A what-if question gives the features that the first submitted event leaves."""
    first = state.last_per_key(
        lake.event_transactions().withColumn("t", -F.unix_micros("event_time")), ["customer_id"], ["t", "transaction_id"]
    ).drop("t").checkpoint()
    scenarios = first.withColumnRenamed("transaction_id", "scenario_id")
    day = first.agg(F.max(F.to_date("event_time"))).first()[0]
    asked = state.what_if_features(scenarios, lake.table("state"), lake.accounts(), day)
    measures = state.trail_measures(first, lake.table("state"), lake.accounts())
    submitted = state.features_from_measures(measures, day, "online")
    assert as_set(rounded(asked)) == as_set(rounded(submitted))


def test_state_of_a_customer_without_history(spark):
    profiles = spark.createDataFrame(
        [(1, "t", "s", 100.0)], "customer_id long, institution_id string, source_system string, income double"
    )
    loans = spark.createDataFrame(
        [], "loan_id string, customer_id long, institution_id string, source_system string, loan_amount double,"
        " loan_status string, days_past_due int, default_flag int"
    )
    none = spark.createDataFrame([], TRANSACTIONS)
    base = state.base_state(profiles, loans, none)
    events = spark.sql(
        "SELECT concat('e', id) AS transaction_id, 1L AS customer_id, 't' AS institution_id, 's' AS source_system,"
        " 'BALANCE_SNAPSHOT' AS transaction_type, DATE'2024-01-01' AS transaction_date, 10.0D + id AS amount,"
        " 50.0D AS expected_amount, 0.0D AS delta_amount, 'CURRENT' AS status, 'acc' AS reference_id,"
        " 0 AS days_past_due, TIMESTAMP'2024-01-02' + make_dt_interval(0, 0, id) AS event_time FROM"
        " (SELECT CAST(id AS INT) AS id FROM range(3))"
    )
    trail = state.trail_features(state.trail_measures(events, base, state.known_accounts(none)))
    got = trail.orderBy("event_time").select("total_accounts", "avg_balance", F.round("account_stability", 6)).collect()
    assert [tuple(r) for r in got] == [(1, 10.0, 0.0), (1, 10.5, 0.707107), (1, 11.0, 1.0)]


def test_late_batches_do_not_grow_with_files(spark, monkeypatch):
    """However many files the events lie in, every id is looked up in a bounded number of batches."""
    batches = []
    apply = EachOnce.apply

    def noted(self, events, batch_id):
        batches.append(batch_id)
        apply(self, events, batch_id)

    monkeypatch.setattr(EachOnce, "apply", noted)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "40")
    try:
        found = entry.queries()["stream_late"](spark, SMALL)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    events = spark.read.parquet(f"{SMALL}/events.parquet").count()
    assert found.count() == events and found.select("transaction_id").distinct().count() == events
    assert 2 <= len(set(batches)) <= 8
