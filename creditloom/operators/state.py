"""Feature measures that grow event by event.

The measures of a customer (counts, totals, squared deviations, first and last dates) can be updated
from new events alone, so neither a what-if question nor a live update reads the history again.
Features follow the online definitions.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.numbers import MONEY, TOTAL, or_zero, safe_ratio
from creditloom.operators.features import customer_measures, features_from_measures
from creditloom.operators.keyed import last_per_key
from creditloom.operators.running import running

MONEY_INCREMENTS = ["add_balance_total", "add_limit_total", "add_positive_total"]
SUMMED = [
    "add_payments", "add_late", "add_accounts", "add_balances", "add_limits", "add_overdue",
    "add_shift", "add_shift_squared", *MONEY_INCREMENTS,
]
HIGHEST = ["add_max_balance", "add_max_overdue", "add_last"]
LOWEST = ["add_min_balance", "add_first"]

MEASURES = [
    "customer_id", "institution_id", "source_system", "income",
    "total_loans", "active_loans", "closed_loans", "loan_overdue_count", "loan_overdue_total",
    "loan_overdue_max", "active_loan_total", "total_payments", "late_payments", "total_accounts",
    "first_snapshot", "last_snapshot", "balance_count", "balance_total", "balance_deviation",
    "max_balance", "min_balance", "limit_count", "limit_total", "account_overdue_count",
    "account_overdue_total", "account_overdue_max", "positive_total",
]


def base_state(
    profiles: DataFrame, loans: DataFrame, transactions: DataFrame, unique_ids: bool = True
) -> DataFrame:
    """Online measures per customer with a profile, before any new event."""
    return customer_measures(profiles, loans, transactions, "online", unique_ids).select(*MEASURES)


def known_accounts(transactions: DataFrame) -> DataFrame:
    """Every account of every customer, once."""
    balances = transactions.where(
        (F.upper("transaction_type") == "BALANCE_SNAPSHOT") & (F.col("reference_id") != "")
    )
    return balances.select("customer_id", "reference_id").distinct()


def _increments(events: DataFrame, center: Column) -> DataFrame:
    """What each event adds to the measures; ``is_new_account`` and the state's columns are present."""
    payment = F.col("transaction_type") == "LOAN_PAYMENT"
    balance = F.col("transaction_type") == "BALANCE_SNAPSHOT"
    amount, limit, overdue = or_zero(F.col("amount")), F.col("expected_amount"), or_zero(F.col("days_past_due"))

    def count(condition: Column) -> Column:
        return F.when(condition, 1).otherwise(0).cast("long")

    def money(condition: Column, value: Column) -> Column:
        return F.when(condition, value).otherwise(0.0).cast(MONEY).cast(TOTAL)

    shift = F.when(balance, amount - center).otherwise(0.0)
    added = {
        "add_payments": count(payment),
        "add_late": count(payment & (overdue > 0)),
        "add_accounts": count(balance & F.col("is_new_account")),
        "add_balances": count(balance),
        "add_balance_total": money(balance, amount),
        "add_shift": shift,
        "add_shift_squared": shift * shift,
        "add_max_balance": F.when(balance, amount),
        "add_min_balance": F.when(balance, amount),
        "add_limits": count(balance & (limit > 0)),
        "add_limit_total": money(balance & (limit > 0), limit),
        "add_overdue": F.when(balance, overdue).otherwise(0).cast("long"),
        "add_max_overdue": F.when(balance, overdue),
        "add_positive_total": money(balance & (amount > 0), amount),
        "add_first": F.when(balance, F.col("transaction_date")),
        "add_last": F.when(balance, F.col("transaction_date")),
    }
    return events.withColumns(added)


def _state_center() -> Column:
    return safe_ratio(F.col("balance_total"), F.col("balance_count"))


def _merged(rows: DataFrame, center: Column, keep: list[str]) -> DataFrame:
    """Measures after the increments beside them."""

    def plus(measure: str, increment: str) -> Column:
        return (or_zero(F.col(measure)) + F.col(increment)).alias(measure)

    def money_plus(measure: str, increment: str) -> Column:
        return (F.coalesce(F.col(measure), F.lit(0).cast(TOTAL)) + F.col(increment)).cast(TOTAL).alias(measure)

    n = or_zero(F.col("balance_count"))
    all_n = n + F.col("add_balances")
    from_center = F.coalesce(_state_center() - center, F.lit(0.0))
    first_order = n * from_center + F.col("add_shift")
    second_order = or_zero(F.col("balance_deviation")) + n * from_center * from_center + F.col("add_shift_squared")
    deviation = second_order - or_zero(safe_ratio(first_order * first_order, all_n))

    changed = [
        plus("total_payments", "add_payments"),
        plus("late_payments", "add_late"),
        plus("total_accounts", "add_accounts"),
        F.least("first_snapshot", "add_first").alias("first_snapshot"),
        F.greatest("last_snapshot", "add_last").alias("last_snapshot"),
        plus("balance_count", "add_balances"),
        money_plus("balance_total", "add_balance_total"),
        F.greatest(deviation, F.lit(0.0)).alias("balance_deviation"),
        F.greatest("max_balance", "add_max_balance").alias("max_balance"),
        F.least("min_balance", "add_min_balance").alias("min_balance"),
        plus("limit_count", "add_limits"),
        money_plus("limit_total", "add_limit_total"),
        plus("account_overdue_count", "add_balances"),
        plus("account_overdue_total", "add_overdue"),
        F.greatest("account_overdue_max", "add_max_overdue").alias("account_overdue_max"),
        money_plus("positive_total", "add_positive_total"),
    ]
    unchanged = MEASURES[: MEASURES.index("total_payments")]
    return rows.select(*unchanged, *changed, *keep)


def what_if_measures(scenarios: DataFrame, state: DataFrame, accounts: DataFrame) -> DataFrame:
    """Measures of each scenario's customer as if that one transaction had happened.

    Scenarios are normalized events with a ``scenario_id``; each stands alone. Those of unknown
    customers have no state and drop out.
    """
    held = accounts.select("customer_id", "reference_id", F.lit(True).alias("held"))
    marked = scenarios.join(held, ["customer_id", "reference_id"], "left")
    marked = marked.withColumn("is_new_account", F.col("held").isNull())
    columns = ["scenario_id", "transaction_type", "status", "expected_amount", "transaction_date"]
    tenant = ["institution_id", "source_system"]
    joined = marked.drop(*tenant).join(state, "customer_id")
    center = F.coalesce(_state_center(), or_zero(F.col("amount")))
    return _merged(_increments(joined, center), center, columns)


def what_if_features(scenarios: DataFrame, state: DataFrame, accounts: DataFrame, as_of: date) -> DataFrame:
    measures = what_if_measures(scenarios, state, accounts)
    keep = ("scenario_id", "transaction_type", "status", "expected_amount", "transaction_date")
    return features_from_measures(measures, as_of, "online", keep)


def _mark_new_accounts(events: DataFrame, accounts: DataFrame) -> DataFrame:
    """Flags the first event of every account that a customer did not have before."""
    balances = events.where((F.col("transaction_type") == "BALANCE_SNAPSHOT") & (F.col("reference_id") != ""))
    first = balances.groupBy("customer_id", "reference_id").agg(
        F.min(F.struct("event_time", "transaction_id")).alias("first")
    )
    new = first.join(accounts, ["customer_id", "reference_id"], "left_anti")
    marks = new.select(F.col("first.transaction_id").alias("transaction_id"), F.lit(True).alias("is_new_account"))
    marked = events.join(marks, "transaction_id", "left")
    return marked.withColumn("is_new_account", F.coalesce("is_new_account", F.lit(False)))


def trail_measures(events: DataFrame, state: DataFrame, accounts: DataFrame) -> DataFrame:
    """Measures after every event, in the order of event time and transaction id.

    Transaction ids are unique. Customers with very many events are split over tasks by ``running``.
    """
    # deviations are taken from the customer's mean so far, or the mean of the events if there is none
    event_means = events.groupBy("customer_id").agg(
        F.avg(F.when(F.col("transaction_type") == "BALANCE_SNAPSHOT", F.col("amount"))).alias("event_mean")
    )
    centers = state.select("customer_id", _state_center().alias("state_mean")).join(event_means, "customer_id")
    centers = centers.select("customer_id", F.coalesce("state_mean", "event_mean", F.lit(0.0)).alias("center"))

    marked = _mark_new_accounts(events, accounts).join(centers, "customer_id")
    added = _increments(marked, F.col("center")).select(
        "customer_id", "event_time", "transaction_id", "center", *SUMMED, *HIGHEST, *LOWEST
    )
    so_far = running(added, ["customer_id"], ["event_time", "transaction_id"], SUMMED, HIGHEST, LOWEST)
    return _merged(so_far.join(state, "customer_id"), F.col("center"), ["transaction_id", "event_time"])


def trail_features(measures: DataFrame) -> DataFrame:
    """Features after every event, as of the day of the event."""
    return features_from_measures(
        measures, F.to_date("event_time"), "online", ("transaction_id", "event_time")
    ).drop("created_at")


def last_of_trail(trail: DataFrame) -> DataFrame:
    """The row after the last event of each customer."""
    return last_per_key(trail, ["customer_id"], ["event_time", "transaction_id"])
