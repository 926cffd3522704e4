"""Rule-based explanation and advice in words, for every customer."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.bands import first_match, insight_band
from creditloom.functions.numbers import fixed_text, or_zero
from creditloom.functions.rules import fired, first_entries, struct, text, texts
from creditloom.operators.explain import score_trend_ends

POINTS = 3  # default; None keeps all


def feature_snapshot(features: DataFrame, scores: DataFrame) -> DataFrame:
    """Score and the features that explanations use; NULL as 0."""
    counts = ["account_age_days", "total_payments", "late_payments", "max_days_past_due"]
    numbers = [
        "late_payment_ratio", "debt_to_income_ratio", "credit_utilization", "account_stability", "total_debt",
    ]
    score = scores.select("customer_id", "credit_score", "risk_level", "default_probability")
    return score.join(features.select("customer_id", *counts, *numbers), "customer_id").select(
        "customer_id",
        "credit_score",
        "risk_level",
        "default_probability",
        *[or_zero(F.col(c)).cast("int").alias(c) for c in counts],
        *[or_zero(F.col(c)).cast("double").alias(c) for c in numbers],
    )


# Condition, code and wording; {names} are the text columns of _spelled.
STRENGTHS = [
    ("late_payment_ratio <= 0.03", "payments", "Payments are reliable, late {late_text}."),
    ("debt_to_income_ratio <= 0.35", "debt", "Debt is moderate for the income, DTI {dti_text}."),
    ("credit_utilization BETWEEN 0 AND 0.3", "utilization", "Little credit is used, {used_text}."),
    ("account_age_days >= 1095", "history", "The history is long, {years_text} years."),
    ("account_stability <= 5000", "stability", "Balances move little, spread {spread_text}."),
]
NO_STRENGTH = "There is a base to build on."
RISKS = [
    ("late_payment_ratio >= 0.1", "payments", "Many payments are late, {late_text}."),
    ("debt_to_income_ratio > 0.45", "debt_high", "Debt is high for the income, DTI {dti_text}."),
    ("debt_to_income_ratio > 0.35 AND debt_to_income_ratio <= 0.45", "debt_moderate",
     "Debt leaves little room, DTI {dti_text}."),
    ("credit_utilization > 0.5", "utilization", "Much of the credit is used, {used_text}."),
    ("account_age_days < 365", "history", "The history is short, {years_text} years."),
    ("max_days_past_due > 30", "overdue", "Overdue by up to {max_days_past_due} days."),
]
NO_RISK = "No single risk stands out."
HEADLINE = "{credit_score} points: {band}."
SUMMARY = "At a glance: {late_text} of payments late, {dti_text} of income owed, {used_text} of credit in use, {years_text} years on file."


def _spelled(snapshot: DataFrame) -> DataFrame:
    """Adds the numbers as text, each worked out once."""
    scaled = snapshot.select(
        "*",
        (F.col("late_payment_ratio") * 100).alias("_late"),
        (F.col("debt_to_income_ratio") * 100).alias("_dti"),
        (F.col("credit_utilization") * 100).alias("_used"),
        (F.col("account_age_days") / 365).alias("_years"),
    )
    percent = F.lit("%")
    counts = F.concat(F.col("late_payments").cast("string"), F.lit("/"), F.col("total_payments").cast("string"))
    return scaled.select(
        *snapshot.columns,
        insight_band(F.col("credit_score")).alias("band"),
        F.concat(counts, F.lit(" ("), fixed_text(F.col("_late"), 1), F.lit("%)")).alias("late_text"),
        F.concat(fixed_text(F.col("_dti"), 1), percent).alias("dti_text"),
        F.concat(fixed_text(F.col("_used"), 1), percent).alias("used_text"),
        fixed_text(F.col("_years"), 1).alias("years_text"),
        fixed_text(F.col("account_stability"), 0).alias("spread_text"),
    )


def _sentence(template: str) -> str:
    """SQL for a template: {name} stands for a column."""
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(text(literal))
        if name:
            parts.append(f"string({name})")
    return f"concat({', '.join(parts)})"


def _noted(code: str, template: str) -> str:
    return struct({"code": text(code), "text": _sentence(template)})


def _points(rules: list[tuple[str, str, str]], default: str, limit: int | None) -> Column:
    noted = fired([(condition, _noted(code, wording)) for condition, code, wording in rules], _noted("none", default))
    return first_entries(noted, limit)


def score_explanation(snapshot: DataFrame, limit: int | None = POINTS) -> DataFrame:
    """Band, summary, the first ``limit`` strengths and risks or all, and one recommendation per customer."""
    advice = [
        (F.col("debt_to_income_ratio") > 0.5, "reduce_debt"),
        (F.col("late_payment_ratio") > 0.08, "pay_in_time"),
        (F.col("credit_utilization") > 0.5, "use_less_credit"),
    ]
    wording = {
        "reduce_debt": "Reduce debt by 15% or more within two months.",
        "pay_in_time": "Let payments run automatically so that none is late for three months.",
        "use_less_credit": "Use less than 30% of the limit.",
        "keep_going": "Lower balances by a tenth and pay in time for two billing cycles.",
    }
    return _spelled(snapshot).select(
        "customer_id",
        "band",
        F.expr(_sentence(HEADLINE)).alias("headline"),
        F.expr(_sentence(SUMMARY)).alias("summary"),
        _points(STRENGTHS, NO_STRENGTH, limit).alias("strengths"),
        _points(RISKS, NO_RISK, limit).alias("risk_factors"),
        first_match(advice, "keep_going").alias("recommendation_code"),
        first_match([(cond, wording[key]) for cond, key in advice], wording["keep_going"]).alias("recommendation"),
        F.lit("Derived from fixed rules.").alias("confidence_note"),
    )


# Condition, code, impact, timeline. The rest is our wording.
ADVICE_RULES = [
    ("credit_utilization > 0.45", "utilization", "high", "30-45 days",
     "Use less than 30% of the total limit.", "The score reacts quickly to a lower used share."),
    ("late_payment_ratio > 0.05", "late_payments", "high", "30-90 days",
     "Automate payments and check them weekly.", "Fewer negative events and a steadier trend."),
    ("debt_to_income_ratio > 0.4", "debt", "high", "60-90 days",
     "Pay off a tenth of the debt, the costliest first.", "Less pressure on the income."),
]
ADVICE_DEFAULT = ("steady", "medium", "ongoing", "Pay in time and use 10 to 30% of the limit.",
                  "The score can rise slowly.")

MOMENTUM_TEXT = {
    "up": "The score is rising; keep doing what works.",
    "down": "The score is falling; start with the first two actions now.",
    "steady": "Steady payments can move the score further.",
}


def _action(code: str, impact: str, timeline: str, action: str, outcome: str) -> str:
    return texts(code=code, action=action, impact=impact, expected_outcome=outcome, timeline=timeline)


def improvement_advisor(snapshot: DataFrame, points: DataFrame) -> DataFrame:
    """Prioritized actions per customer and where the score is heading."""
    with_trend = _spelled(snapshot).join(score_trend_ends(points), "customer_id", "left")
    rules = [(condition, _action(*action)) for condition, *action in ADVICE_RULES]
    has_trend = F.col("points") >= 2
    momentum = [(has_trend & (F.col("change") >= 20), "up"), (has_trend & (F.col("change") <= -20), "down")]
    return with_trend.select(
        "customer_id",
        F.expr(_sentence(SUMMARY)).alias("overview"),
        fired(rules, _action(*ADVICE_DEFAULT)).alias("prioritized_actions"),
        first_match(momentum, "steady").alias("momentum"),
        first_match([(cond, MOMENTUM_TEXT[key]) for cond, key in momentum], MOMENTUM_TEXT["steady"]).alias(
            "momentum_message"
        ),
    )
