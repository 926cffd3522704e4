"""Submitted transactions: defaults, checks, raw payload and tenant. The same for batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.numbers import LARGEST_AMOUNT, or_zero

# Statuses each kind accepts, the word for late and for in time, and the reference prefix.
KINDS = {
    "LOAN_PAYMENT": (["ON_TIME", "LATE", "PAST_DUE"], "LATE", "ON_TIME", "SIM_LOAN_"),
    "BALANCE_SNAPSHOT": (["CURRENT", "PAST_DUE"], "PAST_DUE", "CURRENT", "SIM_ACC_"),
}


def _is_payment() -> Column:
    return F.col("transaction_type") == "LOAN_PAYMENT"


def _by_kind(payment: Column, balance: Column) -> Column:
    return F.when(_is_payment(), payment).otherwise(balance)


def _checked_status(overdue: Column) -> Column:
    given = F.upper("status")

    def checked(kind: str) -> Column:
        allowed, late, in_time, _ = KINDS[kind]
        return F.when(given.isin(allowed), given).when(overdue > 0, late).otherwise(in_time)

    return _by_kind(checked("LOAN_PAYMENT"), checked("BALANCE_SNAPSHOT"))


def normalize_events(events: DataFrame, today: Column) -> DataFrame:
    """Fills in what a submission left out; ``submitted_*`` keeps the payload as it came.

    Unknown statuses give way to the one that the overdue days imply. A missing expected amount is the
    amount itself for payments and one and a half times the amount, at least 1, for balances.
    """
    overdue = F.greatest(or_zero(F.col("days_past_due")), F.lit(0))
    amount = F.col("amount")
    expected = F.coalesce("expected_amount", _by_kind(amount, F.greatest(amount * 1.5, F.lit(1.0))))
    given_reference = F.when(F.col("reference_id") != "", F.col("reference_id"))
    prefix = _by_kind(F.lit(KINDS["LOAN_PAYMENT"][3]), F.lit(KINDS["BALANCE_SNAPSHOT"][3]))
    return events.select(
        "transaction_id",
        "customer_id",
        "transaction_type",
        F.coalesce("transaction_date", today).alias("transaction_date"),
        "amount",
        expected.alias("expected_amount"),
        (amount - expected).alias("delta_amount"),
        _checked_status(overdue).alias("status"),
        F.coalesce(given_reference, F.concat(prefix, F.col("customer_id").cast("string"))).alias("reference_id"),
        overdue.cast("int").alias("days_past_due"),
        F.col("expected_amount").alias("submitted_expected_amount"),
        F.col("days_past_due").alias("submitted_days_past_due"),
        F.col("transaction_date").alias("submitted_date"),
        "raw_attributes",
        "event_time",
    )


def event_raw_json() -> Column:
    """The payload as JSON, in the field names of its kind; attributes of the event win over fields.

    Works on normalized events. Variant values keep numbers as JSON numbers inside one map.
    """

    def field(value: Column) -> Column:
        return value.cast("variant")

    def fields(**values: Column) -> Column:
        pairs = [part for name, value in values.items() for part in (F.lit(name), field(value))]
        return F.create_map(*pairs)

    day = F.col("submitted_date").cast("string")
    payment = fields(
        RECORD_SOURCE=F.lit("simulated_installments_payments"),
        AMT_PAYMENT=F.col("amount"),
        AMT_INSTALMENT=F.col("submitted_expected_amount"),
        STATUS=F.col("status"),
        DAYS_PAST_DUE=F.col("submitted_days_past_due"),
        SIM_TRANSACTION_DATE=day,
    )
    balance = fields(
        RECORD_SOURCE=F.lit("simulated_credit_balance"),
        AMT_BALANCE=F.col("amount"),
        AMT_CREDIT_LIMIT_ACTUAL=F.col("submitted_expected_amount"),
        SK_DPD=F.col("submitted_days_past_due"),
        STATUS=F.col("status"),
        SIM_TRANSACTION_DATE=day,
    )
    none = F.create_map().cast("map<string,string>")
    attributes = F.coalesce("raw_attributes", none)
    overriding = F.transform_values(attributes, lambda _, value: field(value))
    kept = F.map_filter(_by_kind(payment, balance), lambda name, _: ~F.map_contains_key(attributes, name))
    return F.to_json(F.to_variant_object(F.map_concat(kept, overriding)))


def known_customers(profiles: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Customers that events may refer to: with a profile and, where scores are given, a score."""
    known = profiles.select("customer_id", "institution_id", "source_system")
    return known if scores is None else known.join(scores, "customer_id", "left_semi")


def event_transactions(normalized: DataFrame, known: DataFrame) -> DataFrame:
    """Normalized events of known customers, with the customer's tenant."""
    return normalized.where(rejection(F.lit(True)).isNull()).join(known, "customer_id").select(
        "transaction_id",
        "customer_id",
        "institution_id",
        "source_system",
        "transaction_type",
        "transaction_date",
        "amount",
        "expected_amount",
        "delta_amount",
        "status",
        "reference_id",
        "days_past_due",
        "event_time",
    )


def rejection(known: Column) -> Column:
    """Why an event is not accepted, NULL if it is. ``known``: whether its customer is.

    Amounts beyond ``LARGEST_AMOUNT`` can't be added up in decimals, and infinite ones not at all.
    """
    sizes = [F.coalesce(F.abs(F.col(c)), F.lit(0.0)) for c in ("amount", "expected_amount")]
    return (
        F.when(F.col("transaction_id").isNull(), "no id")
        .when(~F.coalesce(F.col("transaction_type").isin(list(KINDS)), F.lit(False)), "unknown type")
        .when(F.col("amount").isNull() | F.isnan("amount"), "no amount")
        .when((sizes[0] >= LARGEST_AMOUNT) | (sizes[1] >= LARGEST_AMOUNT), "amount out of range")
        .when(~known, "unknown customer")
    )


def rejected_events(normalized: DataFrame, known: DataFrame) -> DataFrame:
    flagged = normalized.join(known.select("customer_id", F.lit(True).alias("_known")), "customer_id", "left")
    reason = rejection(F.coalesce("_known", F.lit(False)))
    return flagged.select("transaction_id", "customer_id", "event_time", reason.alias("reason")).where("reason is not null")
