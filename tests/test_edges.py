"""Small rows for every semantic trap."""

from __future__ import annotations

import json
import math
import random
from datetime import date, datetime
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from creditloom.functions import bands, numbers, scoring
from creditloom.operators import bronze, events, explain, features, serving, silver, training, views
from creditloom.operators.keyed import first_per_key, require_unique, top_n_per_key, upsert
from creditloom.schemas import FEATURE_COLUMNS, SCORE_HISTORY, SCORES, TRANSACTIONS
from creditloom.sources import files

DAY = date(2024, 2, 1)


def frame(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


def raw_json(spark, *documents):
    return frame(spark, "key int, raw_json string", *[(i, d) for i, d in enumerate(documents)])


# --- numbers -------------------------------------------------------------------------------------


def test_json_numbers_of_any_shape(spark, rows):
    df = raw_json(
        spark,
        '{"DAYS":365243.0,"NAME":"a"}',
        '{"DAYS":-1213.7}',
        '{"DAYS":"XNA","NAME":"b"}',
        '{"DAYS":"-12.9","NAME":"c"}',
        '{"NAME":"d"}',
        None,
    )
    parsed = silver.json_fields(df, ("NAME",), ("DAYS",))
    assert [r["DAYS"] for r in rows(parsed, "key")] == [365243, -1213, None, -12, None, None]
    assert [r["NAME"] for r in rows(parsed, "key")] == ["a", None, "b", "c", "d", None]


def test_bad_number_leaves_other_fields_alone(spark, rows):
    parsed = silver.json_fields(raw_json(spark, '{"A":"XNA","B":1.5,"C":"2"}'), (), ("A",), ("B", "C"))
    assert rows(parsed)[0] == {"key": 0, "A": None, "B": 1.5, "C": 2.0}


def test_ratio_guards(spark, rows):
    df = frame(spark, "n double, d double", (1.0, 0.0), (1.0, None), (None, 2.0), (1.0, 4.0))
    assert [r["x"] for r in rows(df.select(numbers.safe_ratio(F.col("n"), F.col("d")).alias("x")))] == [
        None, None, None, 0.25,
    ]


def test_money_sums_do_not_depend_on_order(spark):
    amounts = [0.1] * 1000 + [1e9 + 0.01, -1e9, 123456.789]
    sums = set()
    for seed in range(4):
        random.Random(seed).shuffle(amounts)
        df = frame(spark, "x double", *[(a,) for a in amounts]).repartition(seed + 1)
        sums.add(df.agg(numbers.exact_sum(F.col("x"))).first()[0])
    assert sums == {123556.799}
    small = spark.range(1000).select(F.lit(0.00004).alias("x"))
    assert abs(small.agg(numbers.exact_sum(F.col("x"))).first()[0] - 0.04) < 1e-12
    assert frame(spark, "x double", (1e21,), (1.0,)).agg(numbers.exact_sum(F.col("x"))).first()[0] == 1e21 + 1


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=20, max_size=60), st.integers(0, 2))
def test_fixed_text_rounds_like_python(spark, values, digits):
    values = [v + 0.0 for v in values] + [0.25, 0.35, 2.675, 0.05, 0.5, 1.5, 2.5, 1.005, -0.25, 612.5]
    df = frame(spark, "i int, x double", *enumerate(values))
    shown = df.select("i", numbers.fixed_text(F.col("x"), digits).alias("t")).orderBy("i").collect()
    for row, value in zip(shown, values, strict=True):
        want = f"{value:.{digits}f}"
        # the sign of a value that rounds to zero is kept, as in C
        assert row["t"] == want, value


def test_ties_up_for_browser_text(spark, rows):
    values = [0.25, 0.35, 2.5, 0.45, 1.005]
    df = frame(spark, "i int, x double", *enumerate(values))
    shown = rows(df.select("i", numbers.fixed_text(F.col("x"), 1, "up").alias("t")), "i")
    want = [str(Decimal(v).quantize(Decimal("0.1"), ROUND_HALF_UP)) for v in values]
    assert [r["t"] for r in shown] == want


# --- keys ----------------------------------------------------------------------------------------


def test_amounts_that_cannot_be_added_up_are_unreadable(spark, rows):
    """Infinite, NaN and too large amounts are missing ones, in every layout; the rest of the row stays."""
    bad = ['{"A":1e31,"N":"x"}', '{"A":"Infinity","N":"x"}', '{"A":NaN,"N":"x"}', '{"A":-1e20,"N":"x"}', '{"A":"1e400","N":"x"}']
    good = ['{"A":9e19,"N":"x"}', '{"A" : " 12.5 " , "N":"x"}', '{"A":12.5,"N":"x"}', '{"A":-0.5,"N":"x"}']
    parsed = silver.json_fields(raw_json(spark, *bad, *good), ("N",), (), ("A",))
    assert [(r["A"], r["N"]) for r in rows(parsed, "key")] == [(None, "x")] * 5 + [(9e19, "x"), (12.5, "x"), (12.5, "x"), (-0.5, "x")]


def test_first_per_key_is_the_same_for_any_partitioning(spark):
    values = [(i % 5, i % 7, f"v{i % 11}") for i in range(500)]
    results = set()
    for parts in (1, 3, 8):
        random.Random(parts).shuffle(values)
        df = frame(spark, "k int, a int, b string", *values).repartition(parts)
        results.add(tuple(sorted(tuple(r) for r in first_per_key(df, ["k"]).collect())))
    assert len(results) == 1
    once = first_per_key(frame(spark, "k int, a int, b string", *values), ["k"])
    assert sorted(map(tuple, first_per_key(once, ["k"]).collect())) == sorted(map(tuple, once.collect()))


@pytest.mark.parametrize("salts", [1, 4, 32])
def test_top_n_is_exact_for_a_hot_key(spark, salts):
    values = [(1, f"t{i:05d}", (i * 7919) % 3001) for i in range(3000)] + [(2, "x", 5)]
    df = frame(spark, "k int, id string, v int", *values)
    top = top_n_per_key(df, ["k"], [F.desc("v"), F.desc("id")], 50, spread_by="id", salts=salts)
    got = [(r["k"], r["id"], r["rank"]) for r in top.orderBy("k", "rank").collect()]
    best = sorted((v for v in values if v[0] == 1), key=lambda v: (v[2], v[1]), reverse=True)[:50]
    assert got == [(1, v[1], i + 1) for i, v in enumerate(best)] + [(2, "x", 1)]


def test_duplicate_serving_key_is_an_error(spark):
    df = frame(spark, "customer_id long", (1,), (1,))
    with pytest.raises(ValueError, match="duplicate key"):
        require_unique(df, ["customer_id"])


def test_upsert_replaces_by_key(spark):
    old = frame(spark, "k int, v string", (1, "a"), (2, "b"))
    new = frame(spark, "k int, v string", (2, "c"), (3, "d"))
    assert sorted(map(tuple, upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


# --- bronze and silver ---------------------------------------------------------------------------


def test_ids_with_missing_parts(spark, rows):
    schema = (
        "SK_ID_PREV long, SK_ID_CURR long, NUM_INSTALMENT_VERSION int, NUM_INSTALMENT_NUMBER int,"
        " AMT_INSTALMENT double, AMT_PAYMENT double, DAYS_INSTALMENT int, DAYS_ENTRY_PAYMENT double"
    )
    df = frame(spark, schema, (5, 1, None, 3, 10.0, 9.0, -10, -8.0), (None, 1, 1, 3, 10.0, 9.0, -10, -8.0))
    raw = rows(bronze.loan_payments(df, DAY), "payment_id")
    assert [(r["payment_id"], r["loan_id"]) for r in raw] == [("PAY_1_3", None), ("PAY_5_3", "PREV_5")]
    previous = frame(
        spark,
        "SK_ID_PREV long, SK_ID_CURR long, AMT_CREDIT double",
        (None, 1, 5.0),
        (7, 1, 6.0),
    )
    envelope = bronze.envelope(previous, "previous_application", DAY, loan_id=bronze._prefixed("PREV_", "SK_ID_PREV"))
    assert [r["loan_id"] for r in rows(silver.loans(envelope, DAY))] == ["PREV_7"]


def test_anchor_date(spark, rows):
    df = frame(spark, "ingestion_timestamp timestamp", (datetime(2024, 1, 5, 13),))
    got = rows(df.select(silver.anchor_date().alias("a"), silver.anchor_date("2023-01-02").alias("b")))[0]
    assert got == {"a": date(2024, 1, 5), "b": date(2023, 1, 2)}
    with pytest.raises(ValueError):
        silver.anchor_date("2023-13-01")


def test_far_end_dates_stay(spark, rows):
    loan = json.dumps({"DAYS_LAST_DUE": 365243.0, "AMT_APPLICATION": 3.0, "DAYS_DECISION": -10})
    df = frame(
        spark,
        "loan_id string, customer_id long, institution_id string, source_system string, record_source string,"
        " raw_json string, ingestion_timestamp timestamp",
        ("PREV_1", 1, "t", "s", "previous_application", loan, datetime(2024, 2, 1)),
    )
    got = rows(silver.loans(df).select("loan_amount", "start_date", F.year("end_date").alias("y"), "default_flag"))
    assert got == [{"loan_amount": 3.0, "start_date": date(2024, 1, 22), "y": 3024, "default_flag": 0}]


def balances(spark, *values):
    schema = (
        "account_id string, customer_id long, institution_id string, source_system string, record_source string,"
        " raw_json string, ingestion_timestamp timestamp"
    )
    now = datetime(2024, 3, 31)
    return frame(
        spark, schema, *[(a, c, "t", "s", "r", json.dumps(d, separators=(",", ":")), now) for a, c, d in values]
    )


def test_balance_rules(spark, rows):
    df = balances(
        spark,
        ("CC_1", 1, {"MONTHS_BALANCE": -1, "AMT_BALANCE": 0.0, "SK_DPD": 0}),  # says nothing
        ("CC_2", 1, {"MONTHS_BALANCE": -1, "AMT_BALANCE": -5.0}),
        ("BUR_3", 1, {"MONTHS_BALANCE": -2, "STATUS": "5"}),
        ("BUR_4", 1, {"MONTHS_BALANCE": -2, "STATUS": "C"}),
        ("BUR_5", None, {"MONTHS_BALANCE": -2, "STATUS": "5"}),  # no owner
    )
    got = rows(silver.account_balances(df), "account_id")
    assert [(r["account_id"], r["days_past_due"], r["snapshot_date"]) for r in got] == [
        ("BUR_3", 5, date(2024, 1, 31)),
        ("CC_2", 0, date(2024, 2, 29)),
    ]


def test_malformed_csv_rows_are_dropped(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("SK,AMT\n1,2.5\nx,3\n2,\n3.0,\" 4 \"\n4,5,6\n1.5,1e1\n")
    got = [tuple(r) for r in files.scan_csv(spark, str(path), "SK long, AMT double, LATER int").collect()]
    assert got == [(1, 2.5, None), (None, 3.0, None), (2, None, None), (3, 4.0, None), (None, 10.0, None)]
    assert files.scan_csv(spark, str(path)).columns == ["SK", "AMT"]


# --- features ------------------------------------------------------------------------------------

CUSTOMERS = "customer_id long, institution_id string, source_system string, income double"
LOANS = (
    "loan_id string, customer_id long, institution_id string, source_system string, loan_amount double,"
    " loan_status string, days_past_due int, default_flag int"
)


def transaction(key, customer, kind, day, amount=None, expected=None, status=None, reference=None, overdue=0):
    return (key, customer, "t", "s", kind, day, amount, expected, None, status, reference, overdue, None)


def one_customer(spark, loans=(), transactions=(), income=100.0, mode="offline", as_of=DAY, unique=False):
    df = features.customer_credit_features(
        frame(spark, CUSTOMERS, (1, "t", "s", income)),
        frame(spark, LOANS, *loans),
        frame(spark, TRANSACTIONS, *transactions),
        as_of,
        mode,
        unique,
    )
    return df.first().asDict()


def test_status_pattern_is_unanchored(spark):
    loans = [
        ("a", 1, "t", "s", 10.0, "INACTIVE", None, 0),
        ("b", 1, "t", "s", 20.0, "approved", 3, 1),
        ("c", 1, "t", "s", 30.0, None, None, None),
        ("d", 1, "t", "s", 40.0, "Completed", 1, 0),
    ]
    got = one_customer(spark, loans)
    assert (got["total_loans"], got["active_loans"], got["closed_loans"]) == (4, 2, 1)
    assert (got["total_debt"], got["debt_to_income_ratio"], got["default_flag"]) == (30.0, 0.3, 1)
    assert (got["max_days_past_due"], got["avg_days_past_due"]) == (3, 2.0)


def test_zero_denominators(spark):
    late = transaction("p", 1, "LOAN_PAYMENT", DAY, 1.0, 1.0, overdue=2)
    no_id = transaction(None, 1, "LOAN_PAYMENT", DAY, 1.0, 1.0, overdue=2)
    assert one_customer(spark, transactions=[no_id])["late_payment_ratio"] == 0.0
    snapshot = transaction("b", 1, "BALANCE_SNAPSHOT", DAY, 5.0, 0.0, reference="a")
    got = one_customer(spark, transactions=[late, snapshot], income=0.0)
    assert (got["credit_utilization"], got["debt_to_income_ratio"], got["total_debt"]) == (0.0, 0.0, 5.0)
    assert got["account_stability"] == 0.0  # a single snapshot has no spread


def test_sides_without_rows_do_not_count(spark):
    snapshot = transaction("b", 1, "BALANCE_SNAPSHOT", DAY, 5.0, 10.0, reference="a", overdue=5)
    got = one_customer(spark, transactions=[snapshot])
    assert (got["max_days_past_due"], got["avg_days_past_due"]) == (5, 5.0)


def test_repeated_ids_are_counted_once_but_late_rows_twice(spark):
    late = transaction("p", 1, "LOAN_PAYMENT", DAY, 1.0, 1.0, overdue=2)
    got = one_customer(spark, transactions=[late, late])
    assert (got["total_payments"], got["late_payments"], got["late_payment_ratio"]) == (1, 2, 2.0)


def test_offline_and_online_definitions_differ_where_they_should(spark):
    rows = [
        transaction("1", 1, "BALANCE_SNAPSHOT", date(2024, 3, 1), 100.0, 0.0, reference="a", overdue=None),
        transaction("2", 1, "BALANCE_SNAPSHOT", date(2024, 3, 5), None, 50.0, reference="a", overdue=4),
    ]
    offline = one_customer(spark, transactions=rows)
    online = one_customer(spark, transactions=rows, mode="online")
    assert (offline["avg_balance"], online["avg_balance"]) == (100.0, 50.0)
    assert (offline["min_balance"], online["min_balance"]) == (100.0, 0.0)
    assert (offline["account_age_days"], online["account_age_days"]) == (-29, 0)
    assert (offline["credit_utilization"], online["credit_utilization"]) == (4.0, 1.0)
    assert (offline["avg_days_past_due"], online["avg_days_past_due"]) == (4.0, 2.0)
    assert (offline["account_stability"], round(online["account_stability"], 6)) == (0.0, 70.710678)
    assert "default_flag" in offline and "default_flag" not in online
    assert one_customer(spark, transactions=rows, mode="online", as_of=None)["account_age_days"] == 4


def test_unique_ids_only_change_the_plan(spark):
    rows = [transaction(str(i), 1, "LOAN_PAYMENT", DAY, 1.0, 2.0, overdue=i % 2) for i in range(9)]
    loans = [("a", 1, "t", "s", 10.0, "Active", 1, 0)]
    assert one_customer(spark, loans, rows) == one_customer(spark, loans, rows, unique=True)


def test_customer_of_two_institutions_is_multi(spark, rows):
    df = frame(spark, CUSTOMERS, (1, "t", "s", 5.0), (1, "u", "s", 9.0), (2, None, "s", None))
    assert rows(features.customer_meta(df), "customer_id") == [
        {"customer_id": 1, "institution_id": "multi", "source_system": "s", "income": 9.0},
        {"customer_id": 2, "institution_id": None, "source_system": "s", "income": None},
    ]


def test_vector_order(spark, rows):
    df = frame(spark, "customer_id long, " + ", ".join(f"{c} double" for c in FEATURE_COLUMNS), (1, *map(float, range(16)), None))
    got = rows(features.feature_values(df), "position")
    assert [r["feature"] for r in got] == FEATURE_COLUMNS
    assert [r["value"] for r in got] == [float(i) for i in range(16)] + [0.0]


# --- scoring -------------------------------------------------------------------------------------


def scored(spark, probabilities, config=scoring.PUBLISHED):
    p = F.col("p")
    df = frame(spark, "i int, p double", *enumerate(probabilities))
    calibrated = scoring.calibrate(p, config)
    return df.select(
        "i", calibrated.alias("c"), scoring.credit_score(p, config).alias("s"),
        scoring.credit_score(calibrated, config).alias("cs"), scoring.risk_level(p, config).alias("r"),
        scoring.risk_level(calibrated, config).alias("cr"),
    ).orderBy("i").collect()


def test_published_numbers_by_hand(spark):
    row = scored(spark, [0.5])[0]
    assert math.isclose(row["c"], 0.083585, abs_tol=1e-6)
    assert (row["cs"], row["cr"]) == (598, "MEDIUM")


def test_probability_ends(spark):
    low, high, five, fifteen, above = scored(spark, [0.0, 1.0, 0.05, 0.15, 0.1500001])
    assert 0 < low["c"] < high["c"] < 1
    assert (low["s"], high["s"]) == (850, 300)
    assert (five["r"], fifteen["r"], above["r"]) == ("LOW", "MEDIUM", "HIGH")


def test_half_points_round_to_even(spark, rows):
    df = frame(spark, "v double", (612.5,), (613.5,), (299.2,), (900.0,))
    got = [r["s"] for r in rows(df.select("v", scoring._as_score(F.col("v"), scoring.PUBLISHED).alias("s")))]
    assert got == [612, 614, 300, 850]


def test_scores_fall_with_probability(spark):
    points = [i / 500 for i in range(501)]
    for config in (scoring.PUBLISHED, scoring.ScoringConfig()):
        scores = [r["cs"] for r in scored(spark, points, config)]
        assert scores == sorted(scores, reverse=True)
        assert min(scores) >= 300 and max(scores) <= 850


def test_metadata_defaults_and_round_trip(spark, tmp_path):
    document = tmp_path / "m.json"
    document.write_text(json.dumps({"scorecard": {"method": "log_odds", "pdo": 40}, "auc": 0.7}, indent=2))
    config = files.load_scoring_config(spark, str(document))
    assert config == scoring.ScoringConfig(scorecard="log_odds", points_to_double_odds=40.0)
    files.save_scoring_config(spark, scoring.PUBLISHED, str(tmp_path / "saved"), auc=0.5)
    assert files.load_scoring_config(spark, str(tmp_path / "saved")) == scoring.PUBLISHED


def test_named_bands_differ(spark, rows):
    df = frame(spark, "s int", (760,), (745,), (670,), (600,), (500,))
    got = rows(df.select(bands.insight_band(F.col("s")).alias("i"), bands.consumer_band(F.col("s")).alias("c")))
    assert [r["i"] for r in got] == ["EXCELLENT", "GOOD", "FAIR", "REBUILDING", "REBUILDING"]
    assert [r["c"] for r in got] == ["Very Good", "Very Good", "Good", "Fair", "Needs Work"]


# --- serving -------------------------------------------------------------------------------------


def history(spark, *points):
    return frame(spark, SCORE_HISTORY, *[(i, c, s, 0.1, "LOW", t, "SIMULATION") for i, (c, s, t) in enumerate(points)])


def scores(spark, *values):
    return frame(spark, SCORES, *[(c, "t", "s", s, 0.1, "LOW", t) for c, s, t in values])


def test_history_keeps_the_newest_points_and_falls_back(spark, rows):
    points = [(1, 500 + i, datetime(2020 + i, 1, 1)) for i in range(5)] + [(1, 400, None)]
    current = scores(spark, (1, 700, datetime(2030, 1, 1)), (2, 600, datetime(2024, 1, 1)))
    got = rows(serving.score_history(history(spark, *points), current, 3), "customer_id", "point")
    assert [(r["customer_id"], r["point"], r["credit_score"]) for r in got] == [
        (1, 1, 502), (1, 2, 503), (1, 3, 504), (2, 1, 600),
    ]
    everything = rows(serving.score_history(history(spark, *points), current, 12), "customer_id", "point")
    assert everything[0]["credit_score"] == 400  # without a time it counts as oldest


def test_undated_point_takes_the_current_month(spark, rows):
    points = serving.score_history(history(spark, (1, 500, None)), scores(spark, (1, 600, datetime(2023, 5, 6))))
    got = rows(serving.score_history_points(points, scores(spark, (1, 600, datetime(2023, 5, 6))), DAY))
    assert (got[0]["period"], got[0]["is_estimated"]) == ("2023-05", False)


def test_same_day_transactions_come_by_id_descending(spark, rows):
    df = frame(
        spark,
        TRANSACTIONS,
        transaction("a", 1, "LOAN_PAYMENT", DAY),
        transaction("c", 1, "LOAN_PAYMENT", DAY),
        transaction("b", 1, "LOAN_PAYMENT", DAY),
        transaction("z", 1, "LOAN_PAYMENT", None),
    )
    got = rows(serving.recent_transactions(df), "rank")
    assert [r["transaction_id"] for r in got] == ["c", "b", "a", "z"]
    assert [r["transaction_id"] for r in rows(serving.recent_transactions(df, 2), "rank")] == ["c", "b"]
    with pytest.raises(ValueError):
        serving.recent_transactions(df, 0)


def test_lookback(spark):
    df = frame(
        spark,
        TRANSACTIONS,
        transaction("old", 1, "LOAN_PAYMENT", date(2020, 1, 1)),
        transaction("new", 1, "LOAN_PAYMENT", date(2023, 1, 1)),
        transaction("undated", 1, "LOAN_PAYMENT", None),
    )
    current = scores(spark, (1, 600, datetime(2024, 1, 1)))

    def kept(score_table, days):
        return sorted(r["transaction_id"] for r in serving.within_lookback(df, score_table, days).collect())

    assert kept(current, 1095) == ["new", "undated"]
    assert kept(current, 0) == ["new", "old", "undated"]
    assert kept(scores(spark), 1095) == ["new", "old", "undated"]


def test_search_pads_and_requires_features(spark):
    profiles = frame(
        spark,
        "customer_id long, age int, income double, employment_type string",
        *[(i, 30, 1.0, "x") for i in (17, 27, 30)],
    )
    current = scores(spark, (17, 600, None), (27, 700, None), (30, 800, None))
    found = serving.search_customers(profiles, current, " 7 ", 10)
    assert [r["customer_id"] for r in found.collect()] == [27, 17]
    complete = serving.search_customers(profiles, current, None, 10, frame(spark, "customer_id long", (17,)))
    assert [r["customer_id"] for r in complete.collect()] == [17]


def test_top_active_customer_falls_back_to_the_best(spark):
    profiles = frame(
        spark, "customer_id long, age int, income double, employment_type string", (1, 1, 1.0, "x"), (2, 1, 1.0, "x")
    )
    current = scores(spark, (1, 800, None), (2, 700, None))
    none = frame(spark, TRANSACTIONS)
    assert serving.top_active_customer(profiles, current, none).first()["customer_id"] == 1
    some = frame(spark, TRANSACTIONS, transaction("a", 2, "LOAN_PAYMENT", DAY))
    assert serving.top_active_customer(profiles, current, some).first()["customer_id"] == 2


def test_contributors_order_and_neutral(spark, rows):
    df = frame(
        spark,
        TRANSACTIONS,
        transaction("n", 1, "LOAN_PAYMENT", DAY, status=None),
        transaction("p", 1, "LOAN_PAYMENT", DAY, status="on_time"),
        transaction("l1", 1, "LOAN_PAYMENT", date(2024, 1, 1), status="LATE", overdue=3),
        transaction("l2", 1, "LOAN_PAYMENT", DAY, status="PAST_DUE", overdue=9),
        transaction("l3", 1, "LOAN_PAYMENT", DAY, status="LATE", overdue=3),
    )
    got = rows(serving.score_contributors(serving.recent_transactions(df)), "rank")
    assert [r["transaction_id"] for r in got] == ["l2", "l3", "l1", "p", "n"]
    assert got[0]["estimated_score_impact"] == -9 and got[4]["reason"] == "Counts neither way: UNKNOWN."


def feature_rows(spark, **values):
    base = dict.fromkeys(FEATURE_COLUMNS, 0.0) | values
    return frame(spark, "customer_id long, " + ", ".join(f"{c} double" for c in FEATURE_COLUMNS), (1, *base.values()))


def test_factors_rank_and_negative_utilization(spark, rows):
    df = feature_rows(spark, credit_utilization=-0.1, debt_to_income_ratio=0.9, account_age_days=100.0)
    got = rows(explain.score_factors(df), "rank")
    assert [(r["factor"], r["impact"]) for r in got] == [
        ("Account age", "negative"),
        ("Debt-to-income ratio", "negative"),
        ("Maximum days past due", "positive"),
        ("Late payment ratio", "positive"),
    ]


def test_default_recommendation(spark, rows):
    good = feature_rows(spark, account_age_days=2000.0)
    assert [r["title"] for r in rows(explain.base_recommendations(good))] == ["Maintain strong profile"]


def test_first_title_wins_whatever_its_case(spark):
    entries = [("A b", 1), (" a B ", 2), ("", 3), ("c", 4)]
    df = frame(spark, "r array<struct<title string, n int>>", (entries,))
    kept = df.select(explain.first_of_each_title(F.col("r"), 6).alias("r")).first()["r"]
    assert [e["n"] for e in kept] == [1, 4]


def test_plan_has_at_most_six_unique_titles(spark, lake, rows):
    from creditloom.plans.serving_queries import _points, _summary

    plan = explain.personalized_plan(lake.table("features"), _points(lake), _summary(lake))
    per_customer = plan.groupBy("customer_id").agg(
        F.count("*").alias("n"), F.count_distinct(F.lower("title")).alias("d")
    )
    assert per_customer.where("n > 6 OR n <> d").count() == 0


# --- views ---------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("times", "granularity", "last"),
    [
        ([datetime(2022, 1, 1), datetime(2023, 1, 1), datetime(2023, 6, 1)], "year", [1, 3]),
        ([datetime(2023, 1, 1), datetime(2023, 2, 1), datetime(2023, 2, 9)], "month", [1, 3]),
        ([datetime(2023, 1, 1, 5), datetime(2023, 1, 1, 9), datetime(2023, 1, 2)], "day", [2, 3]),
        ([datetime(2023, 1, 1, 5, 7, 1), datetime(2023, 1, 1, 5, 7, 40), datetime(2023, 1, 1, 9)], "time", [2, 3]),
    ],
)
def test_trend_granularity(spark, rows, times, granularity, last):
    points = frame(
        spark,
        "customer_id long, point int, period string, credit_score int, score_generated_at timestamp",
        *[(1, i + 1, "2020-01", i + 1, t) for i, t in enumerate(times)],
    )
    trend = views.score_trend(points)
    got = rows(trend, "place")
    assert {r["granularity"] for r in got} == {granularity}
    assert [r["credit_score"] for r in got] == last
    assert rows(views.score_change(trend)) == [{"customer_id": 1, "score_change": last[1] - last[0]}]


def test_single_point_has_no_change(spark, rows):
    points = frame(
        spark,
        "customer_id long, point int, period string, credit_score int, score_generated_at timestamp",
        (1, 1, "2020-03", 5, None),
    )
    trend = views.score_trend(points)
    assert rows(trend)[0]["bucket"] == datetime(2020, 3, 1)
    assert rows(views.score_change(trend)) == [{"customer_id": 1, "score_change": None}]


def test_page_clamps_and_sorts_nulls(spark, rows):
    df = frame(
        spark,
        TRANSACTIONS,
        *[transaction(f"t{i}", 1, "LOAN_PAYMENT", DAY, float(i) if i else None, 1.0) for i in range(5)],
    )
    recent = serving.recent_transactions(df)
    page = views.transactions_page(recent, sort_by="amount", descending=False, page=9, page_size=2)
    assert [(r["transaction_id"], r["page"], r["pages"]) for r in rows(page, "place")] == [("t4", 3, 3)]
    with pytest.raises(ValueError):
        views.transactions_page(recent, sort_by="nothing")


# --- events --------------------------------------------------------------------------------------

EVENTS = (
    "transaction_id string, customer_id long, transaction_type string, amount double, expected_amount double,"
    " days_past_due int, status string, reference_id string, transaction_date date,"
    " raw_attributes map<string,string>, event_time timestamp"
)


def event(kind, amount, expected=None, overdue=0, status=None, reference=None, day=DAY, attributes=None):
    return ("e", 7, kind, amount, expected, overdue, status, reference, day, attributes, datetime(2024, 2, 1, 8))


def test_event_defaults(spark, rows):
    df = frame(
        spark,
        EVENTS,
        event("BALANCE_SNAPSHOT", 100.0),
        event("BALANCE_SNAPSHOT", 0.2, status="LATE", overdue=3),
        event("LOAN_PAYMENT", 50.0, overdue=-4, status="past_due", reference="", day=None),
        event("LOAN_PAYMENT", 50.0, 80.0, overdue=4, status="bogus", reference="R"),
    )
    got = rows(events.normalize_events(df, F.lit(date(2024, 5, 5))))
    assert [(r["expected_amount"], r["delta_amount"], r["status"], r["reference_id"], r["days_past_due"]) for r in got] == [
        (150.0, -50.0, "CURRENT", "SIM_ACC_7", 0),
        (1.0, -0.8, "PAST_DUE", "SIM_ACC_7", 3),
        (50.0, 0.0, "PAST_DUE", "SIM_LOAN_7", 0),
        (80.0, -30.0, "LATE", "R", 4),
    ]
    assert got[2]["transaction_date"] == date(2024, 5, 5)


def test_raw_payload_and_overrides(spark):
    df = frame(spark, EVENTS, event("LOAN_PAYMENT", 50.0, attributes={"STATUS": "X", "NOTE": "n"}))
    payload = events.normalize_events(df, F.lit(DAY)).select(events.event_raw_json()).first()[0]
    assert json.loads(payload) == {
        "RECORD_SOURCE": "simulated_installments_payments",
        "AMT_PAYMENT": 50.0,
        "AMT_INSTALMENT": None,
        "DAYS_PAST_DUE": 0,
        "SIM_TRANSACTION_DATE": "2024-02-01",
        "STATUS": "X",
        "NOTE": "n",
    }


# --- training ------------------------------------------------------------------------------------


def test_label_guard(spark):
    with pytest.raises(ValueError, match="no feature rows"):
        training.require_two_classes(frame(spark, "default_flag int"))
    with pytest.raises(ValueError, match="single class"):
        training.require_two_classes(frame(spark, "default_flag int", (0,), (0,)))


@pytest.mark.parametrize(("negatives", "positives"), [(80, 20), (93, 11), (7, 3)])
def test_split_has_exact_quotas(spark, negatives, positives):
    labels = [0] * negatives + [1] * positives
    df = frame(spark, "customer_id long, default_flag int", *enumerate(labels))
    split = training.stratified_split(df)
    counts = {(r["default_flag"], r["is_train"]): r["count"] for r in split.groupBy("default_flag", "is_train").count().collect()}
    total = negatives + positives
    assert sum(counts.values()) == total
    assert counts[0, True] + counts[1, True] == total - math.ceil(total * 0.2)
    for label, size in ((0, negatives), (1, positives)):
        assert abs(counts[label, True] - (total - math.ceil(total * 0.2)) * size / total) < 1


def test_area_under_curve_counts_ties_half(spark):
    generator = random.Random(5)
    values = [(generator.randint(0, 1), generator.randint(0, 6) / 7) for _ in range(300)]
    df = frame(spark, "default_flag int, raw_probability double", *values).repartition(5)
    pos = [p for y, p in values if y]
    neg = [p for y, p in values if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert math.isclose(training.area_under_curve(df).first()["auc"], want, abs_tol=1e-12)


def test_platt_fit_recovers_a_shift(spark):
    generator = random.Random(3)
    values = []
    for _ in range(4000):
        logit = generator.uniform(-3, 3)
        p = 1 / (1 + math.exp(-(-1.0 + 0.8 * logit)))
        values.append((int(generator.random() < p), 1 / (1 + math.exp(-logit))))
    intercept, slope = training.platt_fit(frame(spark, "default_flag int, raw_probability double", *values))
    assert abs(intercept + 1.0) < 0.15 and abs(slope - 0.8) < 0.15
