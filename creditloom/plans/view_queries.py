"""Queries on insights and derived views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.functions.bands import insight_band as band_of
from creditloom.operators import insights, views
from creditloom.plans.lake import Lake
from creditloom.plans.registry import query
from creditloom.plans.serving_queries import _labelled_points, _points, _recent, _rounded, _summary


def _snapshot(lake: Lake) -> DataFrame:
    return insights.feature_snapshot(lake.table("features"), lake.table("scores"))


@query(
    """SELECT customer_id, credit_score, CASE WHEN credit_score >= 760 THEN 'EXCELLENT'
       WHEN credit_score >= 700 THEN 'GOOD' WHEN credit_score >= 640 THEN 'FAIR' ELSE 'REBUILDING' END AS band
       FROM score_history"""
)
def insight_band(lake: Lake) -> DataFrame:
    return lake.table("score_history").select(
        "customer_id", "credit_score", band_of(F.col("credit_score")).alias("band")
    )


@query(
    """SELECT * REPLACE (round(default_probability, 9) AS default_probability,
       round(account_stability, 4) AS account_stability) FROM snapshot"""
)
def feature_snapshot(lake: Lake) -> DataFrame:
    return _rounded(_snapshot(lake))


@query(
    """SELECT customer_id,
       CASE WHEN credit_score >= 760 THEN 'EXCELLENT' WHEN credit_score >= 700 THEN 'GOOD'
            WHEN credit_score >= 640 THEN 'FAIR' ELSE 'REBUILDING' END AS band,
       'At a glance: ' || late_payments || '/' || total_payments || ' (' || printf('%.1f', late_payment_ratio * 100)
           || '%) of payments late, ' || printf('%.1f', debt_to_income_ratio * 100) || '% of income owed, '
           || printf('%.1f', credit_utilization * 100) || '% of credit in use, '
           || printf('%.1f', account_age_days / 365::DOUBLE) || ' years on file.' AS summary,
       array_to_string(list_filter([
           CASE WHEN late_payment_ratio <= 0.03 THEN 'payments' END,
           CASE WHEN debt_to_income_ratio <= 0.35 THEN 'debt' END,
           CASE WHEN credit_utilization BETWEEN 0 AND 0.3 THEN 'utilization' END,
           CASE WHEN account_age_days >= 1095 THEN 'history' END,
           CASE WHEN account_stability <= 5000 THEN 'stability' END], lambda x: x IS NOT NULL)[1:3], ',')
           AS strengths,
       coalesce(nullif(array_to_string(list_filter([
           CASE WHEN late_payment_ratio >= 0.1 THEN 'payments' END,
           CASE WHEN debt_to_income_ratio > 0.45 THEN 'debt_high'
                WHEN debt_to_income_ratio > 0.35 THEN 'debt_moderate' END,
           CASE WHEN credit_utilization > 0.5 THEN 'utilization' END,
           CASE WHEN account_age_days < 365 THEN 'history' END,
           CASE WHEN max_days_past_due > 30 THEN 'overdue' END], lambda x: x IS NOT NULL)[1:3], ','), ''), 'none')
           AS risks,
       CASE WHEN debt_to_income_ratio > 0.5 THEN 'reduce_debt' WHEN late_payment_ratio > 0.08 THEN 'pay_in_time'
            WHEN credit_utilization > 0.5 THEN 'use_less_credit' ELSE 'keep_going' END AS recommendation_code
       FROM snapshot"""
)
def score_explanation(lake: Lake) -> DataFrame:
    explained = insights.score_explanation(_snapshot(lake))
    return explained.select(
        "customer_id",
        "band",
        "summary",
        F.array_join("strengths.code", ",").alias("strengths"),
        F.array_join("risk_factors.code", ",").alias("risks"),
        "recommendation_code",
    )


@query(
    """SELECT s.customer_id,
       coalesce(nullif(array_to_string(list_filter([
           CASE WHEN credit_utilization > 0.45 THEN 'utilization' END,
           CASE WHEN late_payment_ratio > 0.05 THEN 'late_payments' END,
           CASE WHEN debt_to_income_ratio > 0.4 THEN 'debt' END], lambda x: x IS NOT NULL), ','), ''), 'steady')
           AS actions,
       CASE WHEN e.points >= 2 AND e.change >= 20 THEN 'up' WHEN e.points >= 2 AND e.change <= -20 THEN 'down'
            ELSE 'steady' END AS momentum
       FROM snapshot s LEFT JOIN history_ends e ON e.customer_id = s.customer_id"""
)
def improvement_advisor(lake: Lake) -> DataFrame:
    advice = insights.improvement_advisor(_snapshot(lake), _points(lake))
    return advice.select("customer_id", F.array_join("prioritized_actions.code", ",").alias("actions"), "momentum")


@query("SELECT * FROM trend")
def score_trend(lake: Lake) -> DataFrame:
    return views.score_trend(_labelled_points(lake))


@query(
    """SELECT customer_id, change AS score_change FROM (SELECT customer_id, place,
           credit_score - lag(credit_score) OVER (PARTITION BY customer_id ORDER BY place) AS change FROM trend)
       QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY place DESC) = 1"""
)
def score_change(lake: Lake) -> DataFrame:
    return views.score_change(views.score_trend(_labelled_points(lake)))


@query(
    """SELECT customer_id, credit_score,
       CASE WHEN credit_score >= 800 THEN 'Exceptional' WHEN credit_score >= 740 THEN 'Very Good'
            WHEN credit_score >= 670 THEN 'Good' WHEN credit_score >= 580 THEN 'Fair' ELSE 'Needs Work' END AS label,
       CASE WHEN credit_score >= 670 THEN 'good' WHEN credit_score >= 580 THEN 'warning' ELSE 'danger' END AS tone
       FROM score_history"""
)
def consumer_band(lake: Lake) -> DataFrame:
    return views.score_bands(lake.table("score_history"))


@query(
    """SELECT customer_id, 1 AS card, 'Payment History' AS label, late_payment_ratio AS number,
       CASE WHEN late_payment_ratio <= 0.03 THEN 'Excellent' WHEN late_payment_ratio <= 0.08 THEN 'Good'
            ELSE 'Needs Work' END AS value,
       CASE WHEN late_payment_ratio <= 0.03 THEN 'good' WHEN late_payment_ratio <= 0.08 THEN 'warning'
            ELSE 'danger' END AS tone FROM snapshot
       UNION ALL SELECT customer_id, 2, 'Credit Utilization', credit_utilization,
       CASE WHEN credit_utilization <= 0.1 THEN 'Very Low' WHEN credit_utilization <= 0.3 THEN 'Healthy'
            WHEN credit_utilization <= 0.5 THEN 'Moderate' ELSE 'High' END,
       CASE WHEN credit_utilization <= 0.3 THEN 'good' WHEN credit_utilization <= 0.5 THEN 'warning'
            ELSE 'danger' END FROM snapshot
       UNION ALL SELECT customer_id, 3, 'Account Age', years, CAST(years AS INTEGER) || ' years',
       CASE WHEN years >= 7 THEN 'good' WHEN years >= 3 THEN 'warning' ELSE 'danger' END
       FROM (SELECT customer_id, greatest(floor(account_age_days / 365::DOUBLE + 0.5), 0) AS years FROM snapshot)
       UNION ALL SELECT customer_id, 4, 'Debt Ratio', debt_to_income_ratio,
       CASE WHEN debt_to_income_ratio <= 0.3 THEN 'Low' WHEN debt_to_income_ratio <= 0.45 THEN 'Moderate'
            ELSE 'High' END,
       CASE WHEN debt_to_income_ratio <= 0.3 THEN 'good' WHEN debt_to_income_ratio <= 0.45 THEN 'warning'
            ELSE 'danger' END FROM snapshot"""
)
def factor_cards(lake: Lake) -> DataFrame:
    return views.factor_cards(lake.table("features")).drop("metric")


@query("SELECT transaction_id, customer_id, activity, tone FROM labelled")
def event_label(lake: Lake) -> DataFrame:
    labelled = views.labelled_events(lake.table("transactions"))
    return labelled.select("transaction_id", "customer_id", "activity", "tone")


@query(
    """SELECT transaction_id, detail, CASE detail WHEN 'days_past_due' THEN days_past_due::DOUBLE
           WHEN 'scheduled' THEN expected_amount
           WHEN 'share_of_limit' THEN coalesce(amount, 0) / expected_amount END AS detail_value
       FROM (SELECT *, CASE
           WHEN transaction_type = 'LOAN_PAYMENT' AND (days_past_due > 0 OR status IN ('LATE', 'PAST_DUE'))
               THEN 'days_past_due'
           WHEN transaction_type = 'LOAN_PAYMENT' AND coalesce(expected_amount, 0) <> 0 THEN 'scheduled'
           WHEN transaction_type = 'LOAN_PAYMENT' THEN 'on_time'
           WHEN coalesce(expected_amount, 0) > 0 THEN 'share_of_limit'
           WHEN days_past_due > 0 THEN 'days_past_due' ELSE 'balance_update' END AS detail
           FROM silver_transactions)"""
)
def event_usage(lake: Lake) -> DataFrame:
    return views.event_usage(lake.table("transactions")).select("transaction_id", "detail", "detail_value")


@query(
    """SELECT customer_id, transaction_id, place, page, pages FROM (
         SELECT *, CAST(least(2, pages) AS INTEGER) AS page FROM (
           SELECT r.customer_id, r.transaction_id,
                  CAST(row_number() OVER (PARTITION BY r.customer_id
                      ORDER BY coalesce(r.amount, 0), r.rank) AS INTEGER) AS place,
                  CAST(ceil(count(*) OVER (PARTITION BY r.customer_id) / 20.0) AS INTEGER) AS pages
           FROM recent r))
       WHERE ceil(place / 20.0) = page"""
)
def transactions_page(lake: Lake) -> DataFrame:
    page = views.early_page(lake.table("transactions"), sort_by="amount", descending=False, page=2, more=[])
    return page.select("customer_id", "transaction_id", "place", "page", "pages")


@query(
    """SELECT f.customer_id, f.total_accounts AS accounts, f.active_loans, 1 - f.late_payment_ratio AS on_time_share,
       s.latest_transaction_date
       FROM gold_features f LEFT JOIN recent_summary s ON s.customer_id = f.customer_id"""
)
def overview_tiles(lake: Lake) -> DataFrame:
    return views.overview_tiles(lake.table("features"), _summary(lake))
