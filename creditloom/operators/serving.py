"""What a customer portal reads, for all customers at once; filter by customer for a single one."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.functions.numbers import exact_sum, or_zero
from creditloom.operators.keyed import first_per_key, last_per_key, top_n_per_key
from creditloom.schemas import FEATURE_COLUMNS
from creditloom.session import shared_dir

PROFILE_COLUMNS = [
    "customer_id", "institution_id", "source_system", "gender", "age", "income", "employment_type",
    "education", "housing_type", "account_open_date",
]

LOAN_COLUMNS = [
    "loan_id", "customer_id", "institution_id", "source_system", "loan_type", "loan_amount", "loan_status",
    "start_date", "end_date", "days_past_due", "default_flag",
]

SCORE_COLUMNS = [
    "customer_id", "institution_id", "source_system", "credit_score", "default_probability", "risk_level",
    "score_generated_at",
]

TRANSACTION_COLUMNS = [
    "transaction_id", "customer_id", "transaction_type", "transaction_date", "amount", "expected_amount",
    "delta_amount", "status", "reference_id", "days_past_due",
]

PROFILE_TYPES = {"age": "int", "income": "double"}
LOAN_TYPES = {"loan_amount": "double", "days_past_due": "int", "default_flag": "int"}
SCORE_TYPES = {"credit_score": "int", "default_probability": "double"}


def _typed(df: DataFrame, columns: list[str], types: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in columns])


# --- serving tables ------------------------------------------------------------------------------


def serving_profile(customers: DataFrame) -> DataFrame:
    """One profile per customer; the first institution by name if there are several."""
    typed = _typed(customers, PROFILE_COLUMNS, PROFILE_TYPES)
    return first_per_key(typed, ["customer_id"])


def serving_loans(loans: DataFrame) -> DataFrame:
    return _typed(loans, LOAN_COLUMNS, LOAN_TYPES)


def serving_scores(scores: DataFrame) -> DataFrame:
    return _typed(scores, SCORE_COLUMNS, SCORE_TYPES)


def serving_features(features: DataFrame) -> DataFrame:
    return features.select("customer_id", *FEATURE_COLUMNS)


def within_lookback(transactions: DataFrame, scores: DataFrame, days: int = 1095) -> DataFrame:
    """Transactions of the last ``days`` before the newest score; undated ones stay, 0 keeps all."""
    if days <= 0:
        return transactions
    newest = scores.agg(F.max(F.to_date("score_generated_at")).alias("newest"))
    # without any score time there is nothing to count back from, and every date is late enough
    cutoff = newest.select(F.coalesce(F.date_sub("newest", days), F.lit("0001-01-01").cast("date"))).scalar()
    dated = F.col("transaction_date")
    return transactions.where(dated.isNull() | (dated >= cutoff))


def table_counts(**tables: DataFrame) -> DataFrame:
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


# --- customers -----------------------------------------------------------------------------------


def search_customers(
    profiles: DataFrame,
    scores: DataFrame,
    text: str | None = None,
    limit: int = 50,
    features: DataFrame | None = None,
) -> DataFrame:
    """Best scores first, among ids that contain ``text``; with ``features`` only complete customers."""
    wanted = text.strip() if text else ""
    if wanted:
        # on both sides, so that neither ships other customers into the join
        match = F.col("customer_id").cast("string").contains(wanted)
        profiles, scores = profiles.where(match), scores.where(match)
    found = profiles.select("customer_id", "age", "income", "employment_type").join(
        scores.select("customer_id", "credit_score", "risk_level", "default_probability"), "customer_id"
    )
    if features is not None:
        found = found.join(features.select("customer_id"), "customer_id", "left_semi")
    return found.orderBy(F.desc("credit_score"), "customer_id").limit(limit)


SEARCH_COLUMNS = ["age", "income", "employment_type", "credit_score", "risk_level", "default_probability"]
GRAM = 3  # characters of the longest index entry


def search_rows(profiles: DataFrame, scores: DataFrame, features: DataFrame) -> DataFrame:
    """What a search shows of every complete customer."""
    found = profiles.join(scores.select("customer_id", *SEARCH_COLUMNS[3:]), "customer_id")
    return found.join(features.select("customer_id"), "customer_id", "left_semi").select("customer_id", *SEARCH_COLUMNS)


def search_grams(rows: DataFrame) -> DataFrame:
    """gram and customer_id: every one to three characters in a row that an id holds, once, in the order of grams."""
    text = F.col("customer_id").cast("string")
    size = F.length(text)

    def pieces(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))
        return F.when(size >= n, F.transform(places, lambda at: F.substr(text, at, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    every = F.array_distinct(F.concat(*[pieces(n) for n in range(1, GRAM + 1)]))
    listed = rows.where("customer_id IS NOT NULL").select(F.explode(every).alias("gram"), "customer_id")
    return listed.repartitionByRange("gram", "customer_id").sortWithinPartitions("gram", "customer_id")


def search_indexed(rows: DataFrame, grams: DataFrame, text: str | None = None, limit: int = 50) -> DataFrame:
    """``search_customers`` over the two tables above: ids that hold all pieces of ``text`` are looked at, no others.

    Pieces are those of three characters, or the text itself where it is shorter.
    """
    wanted = text.strip() if text else ""
    if not wanted:
        return rows.orderBy(F.desc("credit_score"), "customer_id").limit(limit)
    size = min(GRAM, len(wanted))
    pieces = sorted({wanted[i : i + size] for i in range(len(wanted) - size + 1)})
    lists = grams.where(F.col("gram").isin(pieces))
    if len(pieces) > 1:
        lists = lists.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(pieces))
    ids = lists.where(F.col("customer_id").cast("string").contains(wanted)).select("customer_id")
    return rows.join(ids, "customer_id", "left_semi").orderBy(F.desc("credit_score"), "customer_id").limit(limit)


def customer_profile(profiles: DataFrame) -> DataFrame:
    return profiles.select(*PROFILE_COLUMNS)


def customer_features(features: DataFrame) -> DataFrame:
    return features.select("customer_id", *FEATURE_COLUMNS)


def serving_ready(profiles: DataFrame, scores: DataFrame, features: DataFrame) -> DataFrame:
    """Customers that have a profile, a score and features."""
    ids = profiles.select("customer_id").join(scores, "customer_id", "left_semi")
    return ids.join(features, "customer_id", "left_semi")


def top_active_customer(profiles: DataFrame, scores: DataFrame, transactions: DataFrame) -> DataFrame:
    """The best-scored customer with any transaction, else the best-scored one."""
    found = profiles.select("customer_id").join(scores.select("customer_id", "credit_score"), "customer_id")
    active = transactions.select("customer_id", F.lit(True).alias("has_transactions")).distinct()
    return (
        found.join(active, "customer_id", "left")
        .withColumn("has_transactions", F.coalesce("has_transactions", F.lit(False)))
        .orderBy(F.desc("has_transactions"), F.desc_nulls_last("credit_score"), "customer_id")
        .limit(1)
    )


# --- scores over time ----------------------------------------------------------------------------


def latest_score(scores: DataFrame) -> DataFrame:
    """The newest score per customer; a score without a time counts as oldest."""
    columns = ["customer_id", "credit_score", "risk_level", "default_probability", "score_generated_at"]
    tie_break = [c for c in ("history_id", "credit_score") if c in scores.columns]
    return last_per_key(scores, ["customer_id"], ["score_generated_at", *tie_break]).select(*columns)


def score_history(history: DataFrame, scores: DataFrame, limit: int = 12) -> DataFrame:
    """The newest ``limit`` points per customer, numbered from the oldest.

    Customers without history get their current scores. Both tables go through one shuffle: history
    ranks before current scores, and a current score is dropped where any history exists.
    """
    columns = ["customer_id", "credit_score", "risk_level", "default_probability", "score_generated_at"]
    past = history.select(*columns, "history_id", F.lit(0).alias("fallback"))
    current = scores.select(*columns, F.lit(None).cast("long").alias("history_id"), F.lit(1).alias("fallback"))
    newest_first = [
        F.asc("fallback"),
        F.desc_nulls_last("score_generated_at"),
        F.desc_nulls_last("history_id"),
        F.desc("credit_score"),
    ]
    newest = top_n_per_key(past.unionByName(current), ["customer_id"], newest_first, limit)
    customer = Window.partitionBy("customer_id")
    kept = newest.withColumn("source_kind", F.min("fallback").over(customer)).where("fallback = source_kind")
    point = F.row_number().over(customer.orderBy(F.desc("rank")))
    return kept.select("customer_id", point.alias("point"), *columns[1:])


def score_history_points(points: DataFrame, scores: DataFrame, as_of: date) -> DataFrame:
    """History points labelled by month; an undated point takes the month of the current score."""
    current = latest_score(scores).select("customer_id", F.col("score_generated_at").alias("current_time"))
    labelled = points.join(current, "customer_id", "left")
    day = F.coalesce("score_generated_at", "current_time", F.lit(as_of).cast("timestamp"))
    return labelled.select(
        "customer_id",
        "point",
        F.date_format(day, "yyyy-MM").alias("period"),
        or_zero(F.col("credit_score")).alias("credit_score"),
        F.coalesce("default_probability", F.lit(0.0)).alias("default_probability"),
        F.lit(False).alias("is_estimated"),
        "score_generated_at",
    )


# --- transactions --------------------------------------------------------------------------------


def recent_transactions(
    transactions: DataFrame, limit: int | None = None, transaction_type: str | None = None, salts: int = 32
) -> DataFrame:
    """The newest ``limit`` transactions per customer, or all of them, ranked from the newest.

    With a limit, a customer with a large share of all rows is first cut to it in each of ``salts`` groups. Without one
    the ranks are running counts over range partitions, so that no customer has to fit into one task.
    """
    if limit is not None and limit < 1:
        raise ValueError("limit is at least 1")
    if transaction_type:
        transactions = transactions.where(F.col("transaction_type") == transaction_type.upper())
    rows = transactions.select(*TRANSACTION_COLUMNS)
    if limit is None:
        return ranked_rows(rows, [F.col("transaction_date").desc_nulls_last(), F.col("transaction_id").desc_nulls_last()])
    newest_first = [F.desc_nulls_last("transaction_date"), F.desc_nulls_last("transaction_id")]
    return top_n_per_key(rows, ["customer_id"], newest_first, limit, spread_by="transaction_id", salts=salts)


def ranked_rows(rows: DataFrame, order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """Every row with its number from 1 within its customer, whatever the customer's size."""
    shared_dir(rows.sparkSession)  # sets the checkpoint folder
    # the partition number becomes data, so the partitioned rows are kept
    parted = rows.repartitionByRange("customer_id", *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    sizes = parted.groupBy("customer_id", "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("customer_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("customer_id", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("customer_id", "_part").orderBy(*order))
    numbered = parted.withColumn("_local", local).join(starts, ["customer_id", "_part"])
    return numbered.select(*rows.columns, (F.col("_before") + F.col("_local")).cast("int").alias(rank))


NEGATIVE_STATUS = ["LATE", "PAST_DUE"]
POSITIVE_STATUS = ["ON_TIME", "CURRENT"]


def _status():
    return F.upper(F.coalesce("status", F.lit("")))


def transaction_summary(transactions: DataFrame) -> DataFrame:
    """Count, last day, amount paid and late events over all given transactions of each customer."""
    paid = F.when(F.col("transaction_type") == "LOAN_PAYMENT", F.coalesce("amount", F.lit(0.0))).otherwise(0.0)
    late = F.when(_status().isin(NEGATIVE_STATUS), 1).otherwise(0)
    return transactions.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.max("transaction_date").alias("latest_transaction_date"),
        F.round(exact_sum(paid), 2).alias("total_payment_amount"),
        F.sum(late).alias("late_or_past_due_events"),
    )


def score_contributors(transactions: DataFrame, limit: int = 20) -> DataFrame:
    """The events that speak most for or against a customer: negative first, most overdue first."""
    status, overdue = _status(), or_zero(F.col("days_past_due"))
    negative, positive = status.isin(NEGATIVE_STATUS), status.isin(POSITIVE_STATUS)
    shown = F.when(status == "", "UNKNOWN").otherwise(status)
    judged = transactions.select(
        "customer_id",
        "transaction_id",
        "transaction_date",
        F.coalesce("transaction_type", F.lit("UNKNOWN")).alias("transaction_type"),
        status.alias("status"),
        F.when(negative, "negative").when(positive, "positive").otherwise("neutral").alias("contribution"),
        F.when(negative, -overdue).otherwise(0).alias("estimated_score_impact"),
        F.when(negative, F.concat(F.lit("Counts against: "), shown, F.lit(", overdue by "), overdue.cast("string"), F.lit(" d.")))
        .when(positive, F.concat(F.lit("Counts in favour: "), shown, F.lit(", nothing overdue.")))
        .otherwise(F.concat(F.lit("Counts neither way: "), shown, F.lit(".")))
        .alias("reason"),
    )
    kind = F.when(F.col("contribution") == "negative", 0).when(F.col("contribution") == "positive", 1).otherwise(2)
    order = [
        kind,
        F.desc(F.abs("estimated_score_impact")),
        F.desc_nulls_last("transaction_date"),
        F.desc_nulls_last("transaction_id"),
    ]
    return top_n_per_key(judged, ["customer_id"], order, limit)
