"""Derived views that a portal shows: trends, cards, labels, pages and tiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.functions.bands import consumer_band, consumer_tone, first_match
from creditloom.functions.numbers import fixed_text, or_zero
from creditloom.operators.keyed import top_n_per_key
from creditloom.operators.serving import NEGATIVE_STATUS, ranked_rows


# --- scores --------------------------------------------------------------------------------------


def score_trend(points: DataFrame) -> DataFrame:
    """The last point of each time bucket.

    The bucket is the coarsest of year, month, day and minute that a customer's points differ in.
    """
    time = F.coalesce("score_generated_at", F.to_timestamp(F.concat("period", F.lit("-01")), "yyyy-MM-dd"))
    timed = points.withColumn("time", time).where("time IS NOT NULL")
    customer = Window.partitionBy("customer_id")

    def varies(unit: str) -> Column:
        return F.min(F.date_trunc(unit, "time")).over(customer) != F.max(F.date_trunc(unit, "time")).over(customer)

    granularity = first_match([(varies(unit), unit) for unit in ("year", "month", "day")], "time")
    graded = timed.withColumn("granularity", granularity)
    unit = F.when(F.col("granularity") == "time", "minute").otherwise(F.col("granularity"))
    bucket = F.coalesce(
        *[F.when(unit == name, F.date_trunc(name, "time")) for name in ("year", "month", "day", "minute")]
    )
    bucketed = graded.withColumn("bucket", bucket)
    last = Window.partitionBy("customer_id", "bucket").orderBy(F.desc("time"), F.desc("point"))
    kept = bucketed.withColumn("_place", F.row_number().over(last)).where("_place = 1")
    in_order = F.row_number().over(customer.orderBy("bucket"))
    return kept.select("customer_id", in_order.alias("place"), "granularity", "bucket", "credit_score")


def score_change(trend: DataFrame) -> DataFrame:
    """Last minus previous bucket per customer; NULL with fewer than two."""
    customer = Window.partitionBy("customer_id")
    previous = F.lag("credit_score").over(customer.orderBy("place"))
    last = F.max("place").over(customer)
    steps = trend.select("customer_id", "place", (F.col("credit_score") - previous).alias("score_change"), last.alias("n"))
    return steps.where("place = n").select("customer_id", "score_change")


def score_bands(scores: DataFrame) -> DataFrame:
    score = or_zero(F.col("credit_score"))
    return scores.select(
        "customer_id", "credit_score", consumer_band(score).alias("label"), consumer_tone(score).alias("tone")
    )


# --- metrics -------------------------------------------------------------------------------------


def factor_cards(features: DataFrame) -> DataFrame:
    """Four cards per customer: payments, utilization, age and debt."""
    ratios = {"late": "late_payment_ratio", "used": "credit_utilization", "dti": "debt_to_income_ratio"}
    features = features.withColumns({name: or_zero(F.col(c)).cast("double") for name, c in ratios.items()})
    features = features.withColumns({f"{name}_percent": F.col(name) * 100 for name in ratios})
    late, used, dti = (F.col(name) for name in ratios)
    days = F.greatest(or_zero(F.col("account_age_days")), F.lit(0))
    years = F.floor(or_zero(F.col("account_age_days")) / 365 + F.lit(0.5))  # half up
    years = F.greatest(years, F.lit(0)).cast("int")

    def card(place: int, label: str, number: Column, metric: Column, value: Column, tone: Column) -> Column:
        return F.struct(
            F.lit(place).alias("card"),
            F.lit(label).alias("label"),
            number.cast("double").alias("number"),
            metric.alias("metric"),
            value.alias("value"),
            tone.alias("tone"),
        )

    def percent(name: str) -> Column:
        return F.concat(fixed_text(F.col(f"{name}_percent"), 1, ties="up"), F.lit("%"))

    counts = F.concat(or_zero(F.col("late_payments")).cast("string"), F.lit("/"), or_zero(F.col("total_payments")).cast("string"))
    # fixed values: labels, thresholds and verdicts; the metric is our wording
    cards = F.array(
        card(
            1, "Payment History", late,
            F.concat(counts, F.lit(" late, "), percent("late")),
            first_match([(late <= 0.03, "Excellent"), (late <= 0.08, "Good")], "Needs Work"),
            first_match([(late <= 0.03, "good"), (late <= 0.08, "warning")], "danger"),
        ),
        card(
            2, "Credit Utilization", used,
            F.concat(percent("used"), F.lit(" taken")),
            first_match([(used <= 0.1, "Very Low"), (used <= 0.3, "Healthy"), (used <= 0.5, "Moderate")], "High"),
            first_match([(used <= 0.3, "good"), (used <= 0.5, "warning")], "danger"),
        ),
        card(
            3, "Account Age", years,
            F.concat(F.lit("open for "), F.format_number(days, 0), F.lit(" d")),
            F.concat(years.cast("string"), F.lit(" years")),
            first_match([(years >= 7, "good"), (years >= 3, "warning")], "danger"),
        ),
        card(
            4, "Debt Ratio", dti,
            F.concat(percent("dti"), F.lit(" of income")),
            first_match([(dti <= 0.3, "Low"), (dti <= 0.45, "Moderate")], "High"),
            first_match([(dti <= 0.3, "good"), (dti <= 0.45, "warning")], "danger"),
        ),
    )
    return features.select("customer_id", F.inline(cards))


def overview_tiles(features: DataFrame, summary: DataFrame) -> DataFrame:
    """Accounts, active loans, share of payments in time and last activity."""
    last = summary.select("customer_id", "latest_transaction_date")
    return features.join(last, "customer_id", "left").select(
        "customer_id",
        or_zero(F.col("total_accounts")).alias("accounts"),
        or_zero(F.col("active_loans")).alias("active_loans"),
        (1.0 - F.coalesce("late_payment_ratio", F.lit(0.0))).alias("on_time_share"),
        "latest_transaction_date",
    )


# --- transactions --------------------------------------------------------------------------------


def _upper(column: str) -> Column:
    return F.upper(F.coalesce(F.col(column), F.lit("")))


def _usage() -> Column:
    limit = F.coalesce("expected_amount", F.lit(0.0))
    return F.try_divide(F.coalesce("amount", F.lit(0.0)), F.when(limit > 0, limit))


def _event_cases() -> list[tuple[Column, str, str]]:
    kind = _upper("transaction_type")
    return [
        (_upper("status").isin(NEGATIVE_STATUS), "Late payment", "negative"),
        (kind == "LOAN_PAYMENT", "On-time payment", "positive"),
        ((kind == "BALANCE_SNAPSHOT") & (_usage() < 0.3), "Credit utilization reduced", "positive"),
        (kind == "BALANCE_SNAPSHOT", "Balance updated", "neutral"),
    ]


def event_label() -> Column:
    return first_match([(condition, label) for condition, label, _ in _event_cases()], "Transaction recorded")


def event_tone() -> Column:
    return first_match([(condition, tone) for condition, _, tone in _event_cases()], "neutral")


def labelled_events(transactions: DataFrame) -> DataFrame:
    """Every transaction with its activity label and tone."""
    return transactions.select("*", event_label().alias("activity"), event_tone().alias("tone"))


def event_usage(transactions: DataFrame) -> DataFrame:
    """What the detail line of a transaction says, and the number in it."""
    kind, overdue = _upper("transaction_type"), or_zero(F.col("days_past_due"))
    expected = F.coalesce("expected_amount", F.lit(0.0))
    payment, balance = kind == "LOAN_PAYMENT", kind == "BALANCE_SNAPSHOT"
    late = (overdue > 0) | _upper("status").isin(NEGATIVE_STATUS)
    detail = first_match(
        [
            (payment & late, "days_past_due"),
            (payment & (expected != 0), "scheduled"),
            (payment, "on_time"),
            (balance & (expected > 0), "share_of_limit"),
            (balance & (overdue > 0), "days_past_due"),
            (balance, "balance_update"),
        ],
        "activity",
    )
    number = (
        F.when(F.col("detail") == "days_past_due", overdue.cast("double"))
        .when(F.col("detail") == "scheduled", expected)
        .when(F.col("detail") == "share_of_limit", _usage())
    )
    return transactions.withColumn("detail", detail).withColumn("detail_value", number)


SORT_COLUMNS = ("transaction_date", "activity", "amount", "expected_amount", "status", "reference")


INDEX_ROWS = 200  # of a customer's ordered transactions per entry of a page index


def _sort_key(sort_by: str) -> Column:
    if sort_by not in SORT_COLUMNS:
        raise ValueError(f"sort_by is one of {SORT_COLUMNS}")
    keys = {
        "transaction_date": F.coalesce("transaction_date", F.lit("1970-01-01").cast("date")),
        "activity": F.col("activity"),
        "amount": F.coalesce("amount", F.lit(0.0)),
        "expected_amount": F.coalesce("expected_amount", F.lit(0.0)),
        "status": F.col("tone"),
        "reference": F.coalesce("reference_id", F.lit("")),
    }
    return keys[sort_by]


def _sortable(recent: DataFrame, sort_by: str, transaction_type: str | None) -> DataFrame:
    if transaction_type:
        recent = recent.where(F.col("transaction_type") == transaction_type)
    return labelled_events(recent).withColumn("_key", _sort_key(sort_by))


def page_index(
    recent: DataFrame,
    sort_by: str = "transaction_date",
    descending: bool = True,
    transaction_type: str | None = None,
    rows_per_entry: int = INDEX_ROWS,
) -> DataFrame:
    """Per customer and ``rows_per_entry`` transactions in order: first and last place, the sort key and rank of both, and
    how many transactions the customer has. Stored once, it tells where a page lies without sorting anything."""
    rows = _sortable(recent, sort_by, transaction_type).select("customer_id", "_key", "rank")
    order = [F.col("_key").desc() if descending else F.col("_key").asc(), F.col("rank").asc()]
    placed = ranked_rows(rows, order, "place")
    entry = F.floor((F.col("place") - 1) / rows_per_entry)
    at = F.struct(F.col("_key").alias("key"), F.col("rank").alias("rank"))
    entries = placed.groupBy("customer_id", entry.alias("entry")).agg(
        F.min("place").alias("first"), F.max("place").alias("last"), F.min_by(at, "place").alias("low"), F.max_by(at, "place").alias("high")
    )
    sizes = placed.groupBy("customer_id").agg(F.count(F.lit(1)).alias("total"))
    return entries.join(sizes, "customer_id")


def indexed_page(
    recent: DataFrame,
    index: DataFrame,
    sort_by: str = "transaction_date",
    descending: bool = True,
    transaction_type: str | None = None,
    page: int = 1,
    page_size: int = 20,
) -> DataFrame:
    """``transactions_page`` by an index with the same order and type: only the rows of the entries that a page lies in
    are compared and sorted, some hundreds per customer."""
    pages = F.ceil(F.col("total") / page_size).cast("int")
    shown = F.least(F.lit(page), pages)
    sized = index.withColumn("pages", pages).withColumn("page", shown)
    holds = (F.col("first") <= F.col("page") * page_size) & (F.col("last") > (F.col("page") - 1) * page_size)
    ranges = sized.where(holds).groupBy("customer_id", "pages", "page").agg(
        F.min("first").alias("first"), F.min_by("low", "first").alias("low"), F.max_by("high", "first").alias("high")
    )
    rows = _sortable(recent, sort_by, transaction_type).join(ranges, "customer_id")
    key, rank = F.col("_key"), F.col("rank")

    def comes_before(a: Column, a_rank: Column, b: Column, b_rank: Column) -> Column:
        ahead = a > b if descending else a < b
        return ahead | ((a == b) & (a_rank <= b_rank))

    inside = rows.where(comes_before(F.col("low.key"), F.col("low.rank"), key, rank)).where(
        comes_before(key, rank, F.col("high.key"), F.col("high.rank"))
    )
    order = [key.desc() if descending else key.asc(), rank.asc()]
    local = F.row_number().over(Window.partitionBy("customer_id").orderBy(*order))
    placed = inside.withColumn("place", (F.col("first") - 1 + local).cast("int"))
    return placed.where(F.ceil(F.col("place") / page_size) == F.col("page")).drop("_key", "first", "low", "high")


def transactions_page(
    recent: DataFrame,
    transaction_type: str | None = None,
    sort_by: str = "transaction_date",
    descending: bool = True,
    page: int = 1,
    page_size: int = 20,
) -> DataFrame:
    """One page of every customer's recent transactions; a page too far gives the last one."""
    rows = _sortable(recent, sort_by, transaction_type)
    key = F.col("_key").desc() if descending else F.col("_key").asc()
    placed = ranked_rows(rows, [key, F.col("rank").asc()], "place").drop("_key")
    totals = recent if not transaction_type else recent.where(F.col("transaction_type") == transaction_type)
    totals = totals.groupBy("customer_id").agg(F.ceil(F.count(F.lit(1)) / page_size).cast("int").alias("pages"))
    shown = F.least(F.lit(page), F.col("pages"))
    return placed.join(totals, "customer_id").withColumn("page", shown).where(
        F.ceil(F.col("place") / page_size) == F.col("page")
    )


def early_page(
    transactions: DataFrame,
    transaction_type: str | None = None,
    sort_by: str = "transaction_date",
    descending: bool = True,
    page: int = 1,
    page_size: int = 20,
    more: Sequence[str] | None = None,
) -> DataFrame:
    """``transactions_page`` straight from unranked transactions, for pages near the front.

    A customer's page lies in the first ``page * page_size`` rows of the order, or, if there are fewer rows, is the last page of
    them. Map tasks drop the rest, and rows travel with the columns that order them and those named by ``more``: by default all.
    """
    if transaction_type:
        transactions = transactions.where(F.col("transaction_type") == transaction_type)
    rows = labelled_events(transactions).withColumn("_key", _sort_key(sort_by))
    own = ["customer_id", "transaction_id", "transaction_date"]
    names = [c for c in rows.columns if c != "_key"] if more is None else [*own, *(c for c in more if c not in own)]
    newest = [F.desc_nulls_last("transaction_date"), F.desc_nulls_last("transaction_id")]
    order = [F.col("_key").desc() if descending else F.col("_key").asc(), *newest]
    placed = top_n_per_key(rows.select(*names, "_key"), ["customer_id"], order, page * page_size, "place").drop("_key")
    totals = transactions.groupBy("customer_id").agg(F.ceil(F.count(F.lit(1)) / page_size).cast("int").alias("pages"))
    shown = F.least(F.lit(page), F.col("pages"))
    return placed.join(totals, "customer_id").withColumn("page", shown).where(F.ceil(F.col("place") / page_size) == F.col("page"))
