"""Score factors, recommendations and the customer document, from rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.numbers import or_zero, rounded
from creditloom.functions.rules import fired, first_entries, ranked, struct, text, texts
from creditloom.operators.serving import PROFILE_COLUMNS
from creditloom.schemas import FEATURE_COLUMNS

FACTORS = 6  # defaults; None keeps all
RECOMMENDATIONS = 6
RATIOS = ("dti", "late", "used")

# Factor, side, condition, weight, value, benchmark. The last column is our wording.
FACTOR_RULES = [
    ("Debt-to-income ratio", "negative", "dti > 0.40", "dti - 0.40", "dti", "<= 0.35",
     "The debt is large for this income."),
    ("Debt-to-income ratio", "positive", "dti <= 0.25", "0.35 - dti", "dti", "<= 0.35",
     "The debt is small for this income."),
    ("Late payment ratio", "negative", "late > 0.08", "late - 0.08", "late", "<= 0.05",
     "Many payments arrive after their due day."),
    ("Late payment ratio", "positive", "late <= 0.02", "0.05 - late", "late", "<= 0.05",
     "Nearly all payments arrive in time."),
    ("Credit utilization", "negative", "used > 0.65", "used - 0.65", "used", "<= 0.30",
     "Most of the credit limit is taken."),
    ("Credit utilization", "positive", "used >= 0 AND used <= 0.30", "0.30 - used", "used", "<= 0.30",
     "Much of the credit limit is free."),
    ("Maximum days past due", "negative", "overdue > 30", "overdue - 30", "overdue", "<= 7 days",
     "At least one obligation was overdue for more than a month."),
    ("Maximum days past due", "positive", "overdue = 0", "7", "overdue", "<= 7 days",
     "Nothing was ever overdue."),
    ("Account age", "negative", "age < 365", "(365 - age) / 365.0D", "age", ">= 365 days",
     "The history is shorter than a year."),
    ("Account age", "positive", "age >= 1095", "age / 365.0D", "age", ">= 365 days",
     "The history covers three years or more."),
    ("Active loans", "negative", "open_loans > 5", "open_loans - 5", "open_loans", "<= 5",
     "Many loans run at the same time."),
    ("Account depth", "positive", "accounts >= 4 AND age >= 365", "accounts - 3", "accounts", ">= 3 accounts",
     "Several accounts with some history show how credit is handled."),
]

# Condition, title, priority. Reason and action are our wording.
BASE_RULES = [
    ("dti > 0.40", "Lower debt-to-income ratio", "high",
     "Debt weighs more on this score than anything else.",
     "Pay down the costliest debt first and take on none for two or three months."),
    ("late > 0.05 OR overdue > 7", "Improve payment consistency", "high",
     "Late payments raise the expected risk at once.",
     "Let at least the minimum be paid automatically and look at due days every week."),
    ("used > 0.50", "Reduce credit utilization", "medium",
     "A high share of used credit keeps the score down.",
     "Bring the used share below 30% before statements are made."),
    ("open_loans > 5", "Consolidate active obligations", "medium",
     "Many parallel loans are hard to keep up with.",
     "See whether some of them can be merged into one."),
    ("age < 365", "Build account tenure", "low",
     "A longer history makes the assessment steadier.",
     "Keep old accounts open and in good order."),
]
BASE_DEFAULT = ("Maintain strong profile", "low", "Nothing stands out as a risk.",
                "Keep paying in time and use 10 to 30% of the limit.")

# Conditions, titles and priorities; the last two columns are our wording.
PLAN_RULES = [
    ("points >= 2 AND change <= -25", "Stop score decline first", "high",
     "The score has fallen clearly over the last points.",
     "Take no new credit for a month and serve what is there."),
    ("points >= 2 AND change >= 20", "Protect the positive momentum", "low",
     "The score is rising.", "Go on as before for two more billing cycles."),
    ("negative_events >= 3", "Address recurring negative transactions", "high",
     "Several recent events were late or past due.",
     "List the due days and settle the longest overdue items within two weeks."),
    ("dti > 0.40", "Reduce debt burden over 60 days", "high",
     "Debt is high for this income.", "Aim to pay off a tenth or more of the costliest debt."),
    ("used > 0.50", "Lower revolving utilization", "medium",
     "The used share of credit holds the score back.",
     "Start with the largest account and stay below 30% of each limit."),
    ("late > 0.05", "Eliminate late payments in next 90 days", "high",
     "Being in time counts for a lot.", "Automate the minimum and check once a week that it is covered."),
]


def rule_inputs(features: DataFrame, *extra: str) -> DataFrame:
    """The short names that rule conditions use; NULL counts as 0."""
    names = {
        "dti": "debt_to_income_ratio",
        "late": "late_payment_ratio",
        "used": "credit_utilization",
        "overdue": "max_days_past_due",
        "age": "account_age_days",
        "open_loans": "active_loans",
        "accounts": "total_accounts",
    }
    inputs = features.select(
        "customer_id", *extra, *[or_zero(F.col(column)).alias(short) for short, column in names.items()]
    )
    # ratios are shown with two digits
    return inputs.select("*", *[rounded(F.col(c), 2).alias(f"{c}_shown") for c in RATIOS])


def factors_array(limit: int | None = FACTORS) -> Column:
    """The strongest factors: negatives before positives, then by weight, then by rule order."""
    rules = []
    for number, (factor, side, condition, weight, value, benchmark, detail) in enumerate(FACTOR_RULES):
        shown = f"{value}_shown" if value in RATIOS else f"double({value})"
        fields = {
            "side": "0" if side == "negative" else "1",
            "weight": f"-double({weight})",
            "rule": str(number),
            "factor": text(factor),
            "impact": text(side),
            "value": shown,
            "benchmark": text(benchmark),
            "detail": text(detail),
        }
        rules.append((condition, struct(fields)))
    return first_entries(F.array_sort(fired(rules)), limit)


def without_order(factors: str) -> Column:
    """Factors without the fields that only sorted them."""
    fields = ["factor", "impact", "value", "benchmark", "detail"]
    return F.arrays_zip(*[F.col(factors)[name].alias(name) for name in fields])


def _advice(title: str, priority: str, why: str, action: str) -> str:
    return texts(title=title, priority=priority, why_it_matters=why, action=action)


def _base_rules() -> list[tuple[str, str]]:
    found = [(condition, _advice(*advice)) for condition, *advice in BASE_RULES]
    none = " AND ".join(f"NOT ({condition})" for condition, *_ in BASE_RULES)
    return [*found, (none, _advice(*BASE_DEFAULT))]


def base_recommendations_array() -> Column:
    return fired(_base_rules())


def first_of_each_title(recommendations: Column, limit: int | None) -> Column:
    """Drops later entries with the same title, whatever its case, and keeps the first ``limit``."""

    def title(entry: Column) -> Column:
        return F.lower(F.trim(entry["title"]))

    def is_first(entry: Column, place: Column) -> Column:
        earlier = F.slice(recommendations, F.lit(1), place)
        return (title(entry) != "") & ~F.exists(earlier, lambda other: title(other) == title(entry))

    return first_entries(F.filter(recommendations, is_first), limit)


def with_plan(inputs: DataFrame, name: str = "recommendations", limit: int | None = RECOMMENDATIONS) -> DataFrame:
    """Adds the personal rules' recommendations followed by the basic ones, each title once."""
    rules = [(condition, _advice(*advice)) for condition, *advice in PLAN_RULES]
    merged = inputs.withColumn("_merged", fired([*rules, *_base_rules()]))
    return merged.withColumn(name, first_of_each_title(F.col("_merged"), limit)).drop("_merged")


def score_factors(features: DataFrame, limit: int | None = FACTORS) -> DataFrame:
    """Ranked factors per customer, the first ``limit`` or all."""
    found = rule_inputs(features).select("customer_id", factors_array(limit).alias("factors"))
    return ranked(found, "factors").drop("side", "weight", "rule")


def base_recommendations(features: DataFrame) -> DataFrame:
    found = rule_inputs(features).select("customer_id", base_recommendations_array().alias("recommendations"))
    return ranked(found, "recommendations")


def score_trend_ends(points: DataFrame) -> DataFrame:
    """Number of history points and the change from the first to the last of them."""
    return points.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("points"),
        (F.max_by(or_zero(F.col("credit_score")), "point") - F.min_by(or_zero(F.col("credit_score")), "point")).alias(
            "change"
        ),
    )


SUMMARY_COLUMNS = [
    "total_transactions", "latest_transaction_date", "total_payment_amount", "late_or_past_due_events",
]


def _plan_inputs(features: DataFrame, points: DataFrame, summary: DataFrame, *extra: str) -> DataFrame:
    """Rule inputs with the score trend and the transaction summary; each is joined once."""
    inputs = rule_inputs(features, *extra)
    totals = summary.select("customer_id", *SUMMARY_COLUMNS)
    joined = inputs.join(score_trend_ends(points), "customer_id", "left").join(totals, "customer_id", "left")
    # Negative events lead the contributor ranking, so the three that matter are among its first
    # twenty exactly when the summary counts three: no ranking is needed here.
    counted = joined.withColumn("negative_events", F.col("late_or_past_due_events"))
    return counted.fillna(0, ["points", "change", "negative_events"])


def personalized_plan(
    features: DataFrame, points: DataFrame, summary: DataFrame, limit: int | None = RECOMMENDATIONS
) -> DataFrame:
    """Recommendations per customer, the personal ones first, each title once; the first ``limit`` or all."""
    planned = with_plan(_plan_inputs(features, points, summary), limit=limit)
    return ranked(planned.select("customer_id", "recommendations"), "recommendations")


def customer_dashboard(
    profiles: DataFrame, scores: DataFrame, features: DataFrame, points: DataFrame, summary: DataFrame
) -> DataFrame:
    """One nested document per customer that has profile, score and features.

    Factors and recommendations are arrays computed beside the features they come from, so they cost
    no join; every table that is joined holds one row per customer.
    """
    metrics = F.struct(*FEATURE_COLUMNS)
    inputs = _plan_inputs(features.withColumn("metrics", metrics), points, summary, "metrics")
    explained = with_plan(inputs.withColumn("ordered", factors_array())).select(
        "customer_id", "metrics", without_order("ordered").alias("factors"), "recommendations", *SUMMARY_COLUMNS
    )
    profile = profiles.select("customer_id", F.struct(*PROFILE_COLUMNS).alias("profile"))
    score_fields = ["credit_score", "risk_level", "default_probability", "score_generated_at"]
    score = scores.select("customer_id", F.struct(*score_fields).alias("score"))
    totals = F.struct(
        or_zero(F.col("total_transactions")).alias("total_transactions"),
        F.col("latest_transaction_date"),
        F.coalesce("total_payment_amount", F.lit(0.0)).alias("total_payment_amount"),
        or_zero(F.col("late_or_past_due_events")).alias("late_or_past_due_events"),
    )
    return (
        profile.join(score, "customer_id")
        .join(explained, "customer_id")
        .select(
            "customer_id", "profile", "score", "factors", "recommendations", "metrics",
            totals.alias("transaction_summary"),
        )
    )
