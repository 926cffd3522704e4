"""The seven raw lender sources and the live events, read from the test tables.

Pure arithmetic and text rules over customer, orders, lineitem and events, so that the same rules can be
written in SQL. Dates count from ``AS_OF``.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.sources.files import scan_table

AS_OF = date(2024, 2, 1)


def _offset(column: str) -> Column:
    return F.datediff(F.col(column).cast("date"), F.lit(AS_OF))


def _cents(column: str) -> Column:
    return F.rint(F.col(column) * 100).cast("long")


def application_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return (
        scan_table(spark, sf_dir, "customer")
        .where(key % 20 != 19)
        .select(
            key.alias("SK_ID_CURR"),
            F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("TARGET"),
            F.when(key % 2 == 0, "F").otherwise("M").alias("CODE_GENDER"),
            F.col("c_mktsegment").alias("NAME_INCOME_TYPE"),
            F.concat(F.lit("EDU_"), (F.col("c_nationkey") % 5).cast("string")).alias("NAME_EDUCATION_TYPE"),
            F.concat(F.lit("HOUSE_"), (F.col("c_nationkey") % 3).cast("string")).alias("NAME_HOUSING_TYPE"),
            F.lit("Cash loans").alias("NAME_CONTRACT_TYPE"),
            (-(7000 + key * 37 % 18000)).cast("int").alias("DAYS_BIRTH"),
            (-(key * 13 % 9000)).cast("double").alias("DAYS_REGISTRATION"),
            F.when(key % 50 != 0, 20000 + 10 * F.abs("c_acctbal")).alias("AMT_INCOME_TOTAL"),
            (5 * F.abs("c_acctbal")).alias("AMT_CREDIT"),
            F.when(F.col("c_nationkey") < 20, "t0").otherwise("t1").alias("TENANT"),
        )
    )


def previous_application(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    decided = _offset("o_orderdate")
    status = F.col("o_orderstatus")
    return (
        scan_table(spark, sf_dir, "orders").where(key % 3 != 0)
        .select(
            key.alias("SK_ID_PREV"),
            F.col("o_custkey").alias("SK_ID_CURR"),
            F.col("o_orderpriority").alias("NAME_CONTRACT_TYPE"),
            F.when(status == "F", "Approved")
            .when(status == "O", "Completed")
            .otherwise("Refused")
            .alias("NAME_CONTRACT_STATUS"),
            F.when(key % 7 != 0, F.col("o_totalprice")).alias("AMT_CREDIT"),
            F.col("o_totalprice").alias("AMT_APPLICATION"),
            decided.alias("DAYS_DECISION"),
            (decided + 360).cast("double").alias("DAYS_LAST_DUE"),
        )
    )


def bureau(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    opened = _offset("o_orderdate")
    status = F.col("o_orderstatus")
    return (
        scan_table(spark, sf_dir, "orders").where(key % 3 == 0)
        .select(
            key.alias("SK_ID_BUREAU"),
            F.col("o_custkey").alias("SK_ID_CURR"),
            F.col("o_orderpriority").alias("CREDIT_TYPE"),
            F.when(status == "F", "Closed")
            .when(status == "O", "Active")
            .otherwise("Inactive")
            .alias("CREDIT_ACTIVE"),
            F.col("o_totalprice").alias("AMT_CREDIT_SUM"),
            opened.alias("DAYS_CREDIT"),
            F.when(key % 5 != 0, (opened + 720).cast("double")).alias("DAYS_CREDIT_ENDDATE"),
            F.when(key % 12 == 0, key % 40).otherwise(0).cast("int").alias("CREDIT_DAY_OVERDUE"),
        )
    )


def installments_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = scan_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = scan_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"
    )
    due = _offset("l_shipdate").cast("double")
    # price times (1 - discount), rounded half up to cents in whole numbers
    paid_cents = F.floor((_cents("l_extendedprice") * (100 - _cents("l_discount")) + 50) / 100)
    return (
        lines
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_orderkey").alias("SK_ID_PREV"),
            F.col("o_custkey").alias("SK_ID_CURR"),
            F.lit(1).alias("NUM_INSTALMENT_VERSION"),
            F.col("l_linenumber").alias("NUM_INSTALMENT_NUMBER"),
            F.col("l_extendedprice").alias("AMT_INSTALMENT"),
            (paid_cents / 100).alias("AMT_PAYMENT"),
            _offset("l_shipdate").alias("DAYS_INSTALMENT"),
            (due + F.col("l_quantity") - 45).alias("DAYS_ENTRY_PAYMENT"),
        )
    )


def _monthly(spark: SparkSession, sf_dir: str, third: int) -> DataFrame:
    events = scan_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return events.where(F.col("event_id") % 3 == third)


def _months() -> Column:
    return (-(F.col("event_id") % 96)).cast("int").alias("MONTHS_BALANCE")


def _account() -> Column:
    return (F.col("user_id") * 10 + F.col("event_id") % 2).alias("SK_ID_PREV")


def _days_past_due() -> Column:
    overdue = F.when(F.col("event_type") == "error", F.col("event_id") % 45).otherwise(0)
    return overdue.cast("int").alias("SK_DPD")


def credit_card_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return _monthly(spark, sf_dir, 0).select(
        _account(),
        F.col("user_id").alias("SK_ID_CURR"),
        _months(),
        F.when(kind == "error", -F.col("value")).otherwise(F.col("value")).alias("AMT_BALANCE"),
        F.when(kind == "signup", 0.0).otherwise(500.0).alias("AMT_CREDIT_LIMIT_ACTUAL"),
        _days_past_due(),
        F.lit(0).alias("SK_DPD_DEF"),
    )


def pos_cash_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _monthly(spark, sf_dir, 1).select(
        _account(),
        F.col("user_id").alias("SK_ID_CURR"),
        _months(),
        _days_past_due(),
        F.lit(0).alias("SK_DPD_DEF"),
    )


def bureau_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("event_id") % 8
    return _monthly(spark, sf_dir, 2).select(
        (F.col("event_id") * 3).alias("SK_ID_BUREAU"),
        _months(),
        F.when(code == 6, "C").when(code == 7, "X").otherwise(code.cast("string")).alias("STATUS"),
    )


SOURCES = {
    "application_train": application_train,
    "previous_application": previous_application,
    "bureau": bureau,
    "installments_payments": installments_payments,
    "credit_card_balance": credit_card_balance,
    "POS_CASH_balance": pos_cash_balance,
    "bureau_balance": bureau_balance,
}


def as_transaction_events(events: DataFrame) -> DataFrame:
    """Stand-in for submitted transactions; works on a batch and on a stream."""
    number, kind = F.col("event_id"), F.col("event_type")
    is_payment = kind.isin("purchase", "click")
    attribute = F.get_json_object("props", "$.k").try_cast("int")
    attributes = F.when(number % 17 == 0, F.create_map(F.lit("CHANNEL"), kind, F.lit("STATUS"), F.lit("NOTED")))
    return events.select(
        F.concat(F.lit("SIM::"), number.cast("string")).alias("transaction_id"),
        F.col("user_id").alias("customer_id"),
        F.when(is_payment, "LOAN_PAYMENT").otherwise("BALANCE_SNAPSHOT").alias("transaction_type"),
        F.col("value").alias("amount"),
        F.when(kind != "view", 100.0).alias("expected_amount"),
        F.when(kind == "error", attribute - 50).otherwise(0).alias("days_past_due"),
        F.when(number % 11 == 0, "bogus").when(number % 13 == 0, "late").alias("status"),
        F.when(number % 7 == 0, F.concat(F.lit("CC_"), (F.col("user_id") * 10).cast("string"))).alias(
            "reference_id"
        ),
        F.col("ts").cast("date").alias("transaction_date"),
        F.when(number % 2 == 0, F.coalesce(attributes, F.create_map(F.lit("CHANNEL"), kind)))
        .otherwise(attributes)
        .alias("raw_attributes"),
        F.col("ts").cast("timestamp").alias("event_time"),
    )


def transaction_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_transaction_events(scan_table(spark, sf_dir, "events"))


def score_history(spark: SparkSession, sf_dir: str, score, risk) -> DataFrame:
    """Past scores of three customers in four; every seventeenth score has lost its time.

    ``score`` and ``risk`` turn a probability column into a score and a risk level.
    """
    key = F.col("o_orderkey")
    probability = (key * 7919 % 1000 + 1) / 2000
    time = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(mins=(key % 1440).cast("int"))
    return (
        scan_table(spark, sf_dir, "orders")
        .where(F.col("o_custkey") % 4 != 0)
        .select(
            key.alias("history_id"),
            F.col("o_custkey").alias("customer_id"),
            score(probability).alias("credit_score"),
            probability.alias("default_probability"),
            risk(probability).alias("risk_level"),
            F.when(key % 17 != 0, time).alias("score_generated_at"),
            F.lit("SIMULATION").alias("source"),
        )
    )
