"""Credit features per customer: 17 numbers from profile, loans and transactions.

Two named definitions exist side by side. ``offline`` ignores NULL balances and lets the account age
go negative; ``online`` reads NULL as zero, floors the age at zero, averages only limits above zero and
takes the tenant from every table. Either way the numbers come from one aggregation over the stacked rows of loans and
transactions, so no customer list has to be built and joined to first. Names of tenants are aggregated
apart: a text minimum in the same aggregation would turn it from a hash into a sort of all rows.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.numbers import money_total, or_zero, safe_ratio
from creditloom.schemas import FEATURE_COLUMNS

# Status patterns, matched anywhere in the upper-cased status, so INACTIVE is active.
ACTIVE_STATUS = "ACTIVE|APPROVED"
CLOSED_STATUS = "CLOSED|COMPLETED"

MODES = ("offline", "online")


def _check_mode(mode: str) -> bool:
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}, not {mode!r}")
    return mode == "online"


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


# --- what each table contributes ---------------------------------------------------------------


def _loan_rows(loans: DataFrame, online: bool) -> DataFrame:
    status = F.upper(F.coalesce(F.col("loan_status"), F.lit("")))
    overdue = F.col("days_past_due")
    return loans.select(
        "customer_id",
        "loan_id",
        _flag(status.rlike(ACTIVE_STATUS)).alias("loan_is_active"),
        _flag(status.rlike(CLOSED_STATUS)).alias("loan_is_closed"),
        (or_zero(overdue) if online else overdue).alias("loan_days_past_due"),
        F.when(status.rlike(ACTIVE_STATUS), F.col("loan_amount")).otherwise(0.0).alias("active_amount"),
        "default_flag",
    )


def _loan_measures(unique_ids: bool) -> list[Column]:
    return [
        (F.count("loan_id") if unique_ids else F.count_distinct("loan_id")).alias("total_loans"),
        F.sum("loan_is_active").alias("active_loans"),
        F.sum("loan_is_closed").alias("closed_loans"),
        F.count("loan_days_past_due").alias("loan_overdue_count"),
        F.sum("loan_days_past_due").alias("loan_overdue_total"),
        F.max("loan_days_past_due").alias("loan_overdue_max"),
        money_total(F.col("active_amount")).alias("active_loan_total"),
        F.max("default_flag").alias("default_flag"),
    ]


def _payment_columns(is_payment: Column) -> list[Column]:
    late = _flag(or_zero(F.col("days_past_due")) > 0)
    return [
        F.when(is_payment, F.col("transaction_id")).alias("payment_id"),
        F.when(is_payment, late).alias("payment_is_late"),
    ]


def _payment_measures(unique_ids: bool) -> list[Column]:
    return [
        (F.count("payment_id") if unique_ids else F.count_distinct("payment_id")).alias("total_payments"),
        F.sum("payment_is_late").alias("late_payments"),
    ]


def _balance_columns(is_balance: Column, online: bool) -> list[Column]:
    amount, limit, overdue = F.col("amount"), F.col("expected_amount"), F.col("days_past_due")
    account = F.col("reference_id")
    if online:
        amount, overdue = F.coalesce(amount, F.lit(0.0)), or_zero(overdue)
        limit = F.when(limit > 0, limit)
        account = F.when(account != "", account)
    return [
        F.when(is_balance, account).alias("account_id"),
        F.when(is_balance, F.col("transaction_date")).alias("snapshot_date"),
        F.when(is_balance, amount).alias("balance"),
        F.when(is_balance, limit).alias("credit_limit"),
        F.when(is_balance, overdue).alias("account_days_past_due"),
        F.when(is_balance, F.when(amount > 0, amount).otherwise(0.0)).alias("positive_balance"),
    ]


def _balance_measures(accounts: Column | None = None) -> list[Column]:
    return [
        (F.count_distinct("account_id") if accounts is None else accounts).alias("total_accounts"),
        F.min("snapshot_date").alias("first_snapshot"),
        F.max("snapshot_date").alias("last_snapshot"),
        F.count("balance").alias("balance_count"),
        money_total(F.col("balance")).alias("balance_total"),
        # squared deviations from the mean, summed
        (F.var_pop("balance") * F.count("balance")).alias("balance_deviation"),
        F.max("balance").alias("max_balance"),
        F.min("balance").alias("min_balance"),
        F.count("credit_limit").alias("limit_count"),
        money_total(F.col("credit_limit")).alias("limit_total"),
        F.count("account_days_past_due").alias("account_overdue_count"),
        F.sum("account_days_past_due").alias("account_overdue_total"),
        F.max("account_days_past_due").alias("account_overdue_max"),
        money_total(F.col("positive_balance")).alias("positive_total"),
    ]


def _transaction_rows(transactions: DataFrame, online: bool) -> DataFrame:
    kind = F.upper("transaction_type") if online else F.col("transaction_type")
    return transactions.select(
        "customer_id",
        *_payment_columns(kind == "LOAN_PAYMENT"),
        *_balance_columns(kind == "BALANCE_SNAPSHOT", online),
    )


TENANT = ["institution_id", "source_system"]


def _single_or_multi(column: str) -> Column:
    # min and max differ exactly when there are several values; no distinct count is needed
    lowest, highest = F.min(column), F.max(column)
    return F.when(lowest != highest, F.lit("multi")).otherwise(lowest).alias(column)


def _tenants(tables: list[DataFrame]) -> DataFrame:
    """One tenant per customer over all tables, ``multi`` if there are several."""
    named = [F.when(F.col(c) != "", F.col(c)).alias(c) for c in TENANT]  # an empty name is none
    # Distinct rows first, by hash: a few per customer, whatever the history's length. The row count
    # keeps the optimizer from dropping this step, which would sort all rows for the text minimum.
    rows = reduce(DataFrame.unionByName, [df.select("customer_id", *named) for df in tables]).distinct()
    several = F.count(F.lit(1)) > 1

    def single_or_multi(column: str) -> Column:
        lowest, highest = F.min(column), F.max(column)
        return F.when(several & (lowest != highest), F.lit("multi")).otherwise(lowest).alias(column)

    return rows.groupBy("customer_id").agg(*[single_or_multi(c) for c in TENANT])


# --- the single aggregates ------------------------------------------------------------------------


def customer_universe(customers: DataFrame, loans: DataFrame, transactions: DataFrame) -> DataFrame:
    """Every known customer id of the three tables, once."""
    ids = [df.select("customer_id") for df in (customers, loans, transactions)]
    return reduce(DataFrame.unionByName, ids).dropna().distinct()


def customer_meta(customers: DataFrame) -> DataFrame:
    """Tenant, or ``multi`` for several, and the highest income."""
    return customers.groupBy("customer_id").agg(*[_single_or_multi(c) for c in TENANT], F.max("income").alias("income"))


def loan_aggregates(loans: DataFrame, unique_ids: bool = False) -> DataFrame:
    measures = _loan_rows(loans, online=False).groupBy("customer_id").agg(*_loan_measures(unique_ids))
    return measures.select(
        "customer_id",
        "total_loans",
        "active_loans",
        "closed_loans",
        F.col("loan_overdue_max").alias("loan_max_days_past_due"),
        _loan_overdue_mean().alias("loan_avg_days_past_due"),
        F.col("active_loan_total").cast("double").alias("active_loan_debt"),
        "default_flag",
    )


def payment_aggregates(transactions: DataFrame, unique_ids: bool = False) -> DataFrame:
    is_payment = F.col("transaction_type") == "LOAN_PAYMENT"
    rows = transactions.where(is_payment).select("customer_id", *_payment_columns(F.lit(True)))
    return rows.groupBy("customer_id").agg(*_payment_measures(unique_ids))


def balance_aggregates(transactions: DataFrame, as_of: date) -> DataFrame:
    is_balance = F.col("transaction_type") == "BALANCE_SNAPSHOT"
    rows = transactions.where(is_balance).select("customer_id", *_balance_columns(F.lit(True), False))
    return rows.groupBy("customer_id").agg(*_balance_measures()).select(
        "customer_id",
        "total_accounts",
        F.datediff(F.lit(as_of), "first_snapshot").alias("account_age_days"),
        _balance_mean().alias("avg_balance"),
        "max_balance",
        "min_balance",
        _limit_mean().alias("avg_credit_limit"),
        _balance_spread().alias("account_stability"),
        F.col("account_overdue_max").alias("account_max_days_past_due"),
        _account_overdue_mean().alias("account_avg_days_past_due"),
        F.col("positive_total").cast("double").alias("account_positive_balance"),
    )


# --- measures to features ------------------------------------------------------------------------


def _mean(total: str, count: str) -> Column:
    return safe_ratio(F.col(total), F.col(count))


def _loan_overdue_mean() -> Column:
    return _mean("loan_overdue_total", "loan_overdue_count")


def _account_overdue_mean() -> Column:
    return _mean("account_overdue_total", "account_overdue_count")


def _balance_mean() -> Column:
    return _mean("balance_total", "balance_count")


def _limit_mean() -> Column:
    return _mean("limit_total", "limit_count")


def _balance_spread() -> Column:
    """Sample standard deviation; NULL for fewer than two balances."""
    return F.sqrt(safe_ratio(F.col("balance_deviation"), F.col("balance_count") - 1))


def combined_max_days_past_due(loan_max: Column, account_max: Column) -> Column:
    """The larger side; a side without rows does not count."""
    return F.coalesce(F.greatest(loan_max, account_max), F.lit(0)).cast("int")


def combined_avg_days_past_due(loan_avg: Column, account_avg: Column) -> Column:
    """Mean of the side averages that exist."""
    sides = F.when(loan_avg.isNotNull() & account_avg.isNotNull(), 2.0).otherwise(1.0)
    return (F.coalesce(loan_avg, F.lit(0.0)) + F.coalesce(account_avg, F.lit(0.0))) / sides


def features_from_measures(
    measures: DataFrame, as_of: date | Column | None, mode: str = "offline", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Gold feature rows from rows of measures.

    ``as_of`` may be None online: the age then counts to the newest snapshot. ``keep`` names further
    columns to carry along.
    """
    online = _check_mode(mode)
    today = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")
    age = F.datediff(F.coalesce(today, F.col("last_snapshot")), "first_snapshot")
    age = F.coalesce(age, F.lit(0))
    income, limit = F.col("income"), _limit_mean()
    if online:
        age = F.greatest(age, F.lit(0))
        income, limit = F.when(income > 0, income), F.when(limit > 0, limit)

    def debt_part(total: str) -> Column:
        return F.coalesce(F.col(total).cast("double"), F.lit(0.0))

    debt = debt_part("active_loan_total") + debt_part("positive_total")
    derived = {
        "account_age_days": age,
        "avg_balance": or_zero(_balance_mean()),
        "late_payment_ratio": or_zero(_mean("late_payments", "total_payments")),
        "max_days_past_due": combined_max_days_past_due(F.col("loan_overdue_max"), F.col("account_overdue_max")),
        "avg_days_past_due": combined_avg_days_past_due(_loan_overdue_mean(), _account_overdue_mean()),
        "total_debt": debt,
        "debt_to_income_ratio": or_zero(safe_ratio(debt, income)),
        "credit_utilization": or_zero(safe_ratio(_balance_mean(), limit)),
        "account_stability": or_zero(_balance_spread()),
    }
    # counts and ages are int, the rest double
    counts = {
        "total_accounts", "account_age_days", "total_loans", "active_loans", "closed_loans",
        "total_payments", "late_payments", "max_days_past_due",
    }
    features = []
    for name in FEATURE_COLUMNS:
        value = derived.get(name, or_zero(F.col(name)))
        features.append(value.cast("int" if name in counts else "double").alias(name))

    label = [] if online else [or_zero(F.col("default_flag")).cast("int").alias("default_flag")]
    return measures.select(
        F.col("customer_id").cast("long").alias("customer_id"),
        F.coalesce("institution_id", F.lit("unknown")).alias("institution_id"),
        F.coalesce("source_system", F.lit("unknown")).alias("source_system"),
        *features,
        *label,
        today.cast("timestamp").alias("created_at"),
        *keep,
    )


SALTS = 4  # groups of a customer's rows without an account


def _in_cells(rows: DataFrame) -> DataFrame:
    """Adds ``_cell``, the account or, in rows without one, one of a few salts, and ``_salt``, the bit of that salt.

    Rows are aggregated where all rows of a cell meet: the measures of a customer are wide, and aggregated in the tasks that read
    the rows there would be one set of them per customer and task, in the end one per row.
    """
    salt = F.pmod(F.xxhash64(F.coalesce("loan_id", "payment_id", F.col("snapshot_date").cast("string"))), F.lit(SALTS))
    bit = F.when(F.col("account_id").isNull(), F.call_function("shiftleft", F.lit(1), salt.cast("int")))
    cell = F.coalesce(F.concat(F.lit("="), "account_id"), salt.cast("string"))
    return rows.withColumns({"_cell": cell, "_salt": bit})


def customer_measures(
    customers: DataFrame,
    loans: DataFrame,
    transactions: DataFrame,
    mode: str = "offline",
    unique_ids: bool = False,
) -> DataFrame:
    """All measures of all customers.

    Offline, customers are read once, for tenant and income; they meet the aggregate of loans and transactions in a full join
    on the partitioning that both aggregations left. Online, tenants come from all three tables.
    """
    online = _check_mode(mode)
    stacked = _loan_rows(loans, online).unionByName(_transaction_rows(transactions, online), allowMissingColumns=True)
    rows = _in_cells(stacked.where(F.col("customer_id").isNotNull()))
    if unique_ids:
        # ids are only counted, and rows are narrower without them
        rows = rows.withColumns({c: F.when(F.col(c).isNotNull(), 1) for c in ("loan_id", "payment_id")})
        # as many tasks as there are, not merged by the rows' size, which is small beside that of the measures
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(tasks, "customer_id", "_cell")
    accounts = F.count_distinct("_cell") - or_zero(F.bit_count(F.bit_or("_salt")))  # cells that are no salt
    measures = rows.groupBy("customer_id").agg(
        *_loan_measures(unique_ids), *_payment_measures(unique_ids), *_balance_measures(accounts)
    )
    people = customers.where(F.col("customer_id").isNotNull())
    if not online:
        return customer_meta(people).join(measures, "customer_id", "full")
    known = people.groupBy("customer_id").agg(F.max("income").alias("income"))
    tenants = _tenants([customers, loans, transactions])
    return known.join(measures, "customer_id", "left").join(tenants, "customer_id", "left")


def customer_credit_features(
    customers: DataFrame,
    loans: DataFrame,
    transactions: DataFrame,
    as_of: date | None,
    mode: str = "offline",
    unique_ids: bool = False,
) -> DataFrame:
    """Features of every customer.

    ``unique_ids`` says that loan and transaction ids are unique, as the silver tables guarantee; then
    ids are counted instead of counted distinct and need not be shuffled.
    """
    if as_of is None and _check_mode(mode) is False:
        raise ValueError("offline features need as_of")
    measures = customer_measures(customers, loans, transactions, mode, unique_ids)
    return features_from_measures(measures, as_of, mode)


def feature_vector(features: DataFrame) -> Column:
    """The ordered 17 features as an array of double, NULL as 0."""
    return F.array(*[F.coalesce(features[c].cast("double"), F.lit(0.0)) for c in FEATURE_COLUMNS])


def feature_values(features: DataFrame) -> DataFrame:
    """One row per customer and feature, in model order."""
    names = F.array(*[F.lit(c) for c in FEATURE_COLUMNS])
    pairs = F.arrays_zip(names.alias("feature"), feature_vector(features).alias("value"))
    return features.select("customer_id", F.posexplode(pairs).alias("position", "pair")).select(
        "customer_id", "position", F.col("pair.feature").alias("feature"), F.col("pair.value").alias("value")
    )
