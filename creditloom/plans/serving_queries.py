"""Queries on the serving tables: reads, histories, explanations and the customer document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.operators import explain, serving
from creditloom.plans.lake import Lake
from creditloom.plans.registry import query
from creditloom.schemas import FEATURE_COLUMNS
from creditloom.session import fresh_path
from creditloom.sources.files import publish_serving

_STABLE_FEATURES = "customer_id, " + ", ".join(
    f"round({c}, 4) AS {c}" if c == "account_stability" else c for c in FEATURE_COLUMNS
)


def _rounded(df: DataFrame) -> DataFrame:
    for name, digits in (("default_probability", 9), ("account_stability", 4)):
        if name in df.columns:
            df = df.withColumn(name, F.round(name, digits))
    return df


def _points(lake: Lake) -> DataFrame:
    return serving.score_history(lake.table("score_history"), lake.table("scores"))


def _labelled_points(lake: Lake) -> DataFrame:
    return serving.score_history_points(_points(lake), lake.table("scores"), lake.as_of)


def _recent(lake: Lake) -> DataFrame:
    return serving.recent_transactions(lake.table("transactions"))


def _summary(lake: Lake) -> DataFrame:
    return serving.transaction_summary(lake.held("transactions"))  # one pass over them


# --- customers -----------------------------------------------------------------------------------


@query(
    """SELECT p.customer_id, p.age, p.income, p.employment_type, s.credit_score, s.risk_level,
       round(s.default_probability, 9) AS default_probability
       FROM profile p JOIN current_scores s ON s.customer_id = p.customer_id
       WHERE CAST(p.customer_id AS VARCHAR) LIKE '%7%'
       ORDER BY s.credit_score DESC, p.customer_id LIMIT 200"""
)
def search_customers(lake: Lake) -> DataFrame:
    found = serving.search_customers(
        lake.table("profile"), lake.table("scores"), " 7 ", 200, features=lake.table("features")
    )
    return _rounded(found)


@query(
    """SELECT p.customer_id, p.age, p.income, p.employment_type, s.credit_score, s.risk_level,
       round(s.default_probability, 9) AS default_probability
       FROM profile p JOIN current_scores s ON s.customer_id = p.customer_id
       WHERE CAST(p.customer_id AS VARCHAR) LIKE '%12%'
       ORDER BY s.credit_score DESC, p.customer_id LIMIT 200"""
)
def search_by_grams(lake: Lake) -> DataFrame:
    return _rounded(serving.search_indexed(lake.bucketed("search_rows"), lake.table("search_grams"), "12", 200))


@query("SELECT * FROM profile")
def customer_profile(lake: Lake) -> DataFrame:
    return serving.customer_profile(lake.table("profile"))


@query(f"SELECT {_STABLE_FEATURES} FROM gold_features")
def customer_features_lookup(lake: Lake) -> DataFrame:
    return _rounded(serving.customer_features(lake.table("features")))


@query(
    """SELECT customer_id, credit_score, risk_level, default_probability, score_generated_at FROM score_history
       QUALIFY row_number() OVER (PARTITION BY customer_id
           ORDER BY score_generated_at DESC NULLS LAST, history_id DESC) = 1"""
)
def latest_score(lake: Lake) -> DataFrame:
    return serving.latest_score(lake.table("score_history"))


@query("SELECT * REPLACE (round(default_probability, 9) AS default_probability) FROM history_points")
def score_history(lake: Lake) -> DataFrame:
    return _rounded(_points(lake))


@query(
    """SELECT customer_id, point, period, credit_score, round(default_probability, 9) AS default_probability,
       false AS is_estimated, score_generated_at FROM history_labelled"""
)
def score_history_points(lake: Lake) -> DataFrame:
    return _rounded(_labelled_points(lake))


@query("SELECT * FROM recent")
def recent_transactions(lake: Lake) -> DataFrame:
    return _recent(lake)


@query(
    """SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY customer_id
           ORDER BY transaction_date DESC NULLS LAST, transaction_id DESC) AS INTEGER) AS rank)
       FROM recent WHERE transaction_type = 'LOAN_PAYMENT'
       QUALIFY row_number() OVER (PARTITION BY customer_id
           ORDER BY transaction_date DESC NULLS LAST, transaction_id DESC) <= 5"""
)
def recent_payments(lake: Lake) -> DataFrame:
    return serving.recent_transactions(lake.table("transactions"), 5, "loan_payment")


@query("SELECT * FROM recent_summary")
def transaction_summary(lake: Lake) -> DataFrame:
    return _summary(lake)


@query(
    """SELECT customer_id, transaction_id, transaction_date, transaction_type, upper(status) AS status,
       CASE WHEN status IN ('LATE', 'PAST_DUE') THEN 'negative' ELSE 'positive' END AS contribution,
       CASE WHEN status IN ('LATE', 'PAST_DUE') THEN -days_past_due ELSE 0 END AS estimated_score_impact,
       CASE WHEN status IN ('LATE', 'PAST_DUE') THEN 'Counts against: ' || status || ', overdue by ' || days_past_due || ' d.'
            ELSE 'Counts in favour: ' || status || ', nothing overdue.' END AS reason,
       CAST(row_number() OVER (PARTITION BY customer_id
           ORDER BY status NOT IN ('LATE', 'PAST_DUE'),
                    CASE WHEN status IN ('LATE', 'PAST_DUE') THEN abs(days_past_due) ELSE 0 END DESC,
                    transaction_date DESC NULLS LAST, rank) AS INTEGER) AS rank
       FROM recent QUALIFY row_number() OVER (PARTITION BY customer_id
           ORDER BY status NOT IN ('LATE', 'PAST_DUE'),
                    CASE WHEN status IN ('LATE', 'PAST_DUE') THEN abs(days_past_due) ELSE 0 END DESC,
                    transaction_date DESC NULLS LAST, recent.rank) <= 20"""
)
def score_contributors(lake: Lake) -> DataFrame:
    return serving.score_contributors(lake.table("transactions"))


@query("SELECT customer_id, rank, factor, impact, value, benchmark FROM factors")
def score_factors(lake: Lake) -> DataFrame:
    return explain.score_factors(lake.table("features")).drop("detail")


@query("SELECT * FROM base_ranked")
def base_recommendations(lake: Lake) -> DataFrame:
    return explain.base_recommendations(lake.table("features")).drop("why_it_matters", "action")


@query("SELECT * FROM plan")
def personalized_plan(lake: Lake) -> DataFrame:
    plan = explain.personalized_plan(lake.table("features"), _points(lake), _summary(lake))
    return plan.drop("why_it_matters", "action")


@query(
    """SELECT p.customer_id, p.age, s.credit_score, f.total_debt,
       (SELECT count(*) FROM factors x WHERE x.customer_id = p.customer_id) AS factor_count,
       (SELECT string_agg(factor, '|' ORDER BY rank) FROM factors x WHERE x.customer_id = p.customer_id) AS factors,
       (SELECT string_agg(title, '|' ORDER BY rank) FROM plan x WHERE x.customer_id = p.customer_id) AS titles,
       coalesce(t.total_transactions, 0) AS total_transactions, t.latest_transaction_date,
       coalesce(t.total_payment_amount, 0) AS total_payment_amount,
       coalesce(t.late_or_past_due_events, 0) AS late_or_past_due_events
       FROM profile p JOIN current_scores s ON s.customer_id = p.customer_id
       JOIN gold_features f ON f.customer_id = p.customer_id
       LEFT JOIN recent_summary t ON t.customer_id = p.customer_id"""
)
def customer_dashboard(lake: Lake) -> DataFrame:
    documents = explain.customer_dashboard(
        lake.table("profile"), lake.table("scores"), lake.table("features"), _points(lake), _summary(lake)
    )
    return documents.select(
        "customer_id",
        "profile.age",
        "score.credit_score",
        "metrics.total_debt",
        F.size("factors").cast("long").alias("factor_count"),
        F.array_join(F.col("factors.factor"), "|").alias("factors"),
        F.array_join(F.col("recommendations.title"), "|").alias("titles"),
        "transaction_summary.*",
    )


@query(
    """SELECT customer_id FROM profile WHERE customer_id IN (SELECT customer_id FROM current_scores)
       AND customer_id IN (SELECT customer_id FROM gold_features)"""
)
def serving_ready(lake: Lake) -> DataFrame:
    return serving.serving_ready(lake.table("profile"), lake.table("scores"), lake.table("features"))


@query(
    """SELECT customer_id, credit_score, customer_id IN (SELECT customer_id FROM silver_transactions)
           AS has_transactions
       FROM (SELECT s.customer_id, s.credit_score FROM current_scores s
             JOIN profile p ON p.customer_id = s.customer_id)
       ORDER BY has_transactions DESC, credit_score DESC, customer_id LIMIT 1"""
)
def top_active_customer(lake: Lake) -> DataFrame:
    profile, transactions = lake.table("profile"), lake.table("transactions")  # before the scores, which read the latter
    return serving.top_active_customer(profile, lake.table("scores"), transactions)


@query(
    """SELECT 'customer_profile' AS table_name, count(*) AS row_count FROM profile
       UNION ALL SELECT 'customer_credit_scores', count(*) FROM current_scores
       UNION ALL SELECT 'customer_credit_features', count(*) FROM gold_features"""
)
def table_counts(lake: Lake) -> DataFrame:
    return serving.table_counts(
        customer_profile=lake.table("profile"),
        customer_credit_scores=lake.table("scores"),
        customer_credit_features=lake.table("features"),
    )


# --- serving tables ------------------------------------------------------------------------------


@query(
    """SELECT transaction_id, customer_id, transaction_date, amount FROM silver_transactions
       WHERE transaction_date IS NULL
          OR transaction_date >= (SELECT CAST(max(score_generated_at) AS DATE) - 1095 FROM current_scores)"""
)
def lookback_filter(lake: Lake) -> DataFrame:
    kept = serving.within_lookback(lake.table("transactions"), lake.table("scores"))
    return kept.select("transaction_id", "customer_id", "transaction_date", "amount")


@query("SELECT * FROM silver_loans")
def serving_loans(lake: Lake) -> DataFrame:
    return serving.serving_loans(lake.table("loans"))


@query("SELECT * REPLACE (round(default_probability, 9) AS default_probability) FROM current_scores")
def serving_scores(lake: Lake) -> DataFrame:
    return _rounded(serving.serving_scores(lake.table("scores")))


@query(f"SELECT {_STABLE_FEATURES} FROM gold_features")
def serving_features(lake: Lake) -> DataFrame:
    return _rounded(serving.serving_features(lake.table("features")))


@query("SELECT * FROM profile")
def serving_profile(lake: Lake) -> DataFrame:
    return serving.serving_profile(lake.table("customers"))


@query(
    """SELECT 'customer_profile' AS table_name, count(*) AS row_count, CAST(sum(customer_id) AS BIGINT) AS id_sum
       FROM profile
       UNION ALL SELECT 'customer_loans', count(*), CAST(sum(customer_id) AS BIGINT) FROM silver_loans
       UNION ALL SELECT 'customer_credit_scores', count(*), CAST(sum(customer_id) AS BIGINT) FROM current_scores
       UNION ALL SELECT 'customer_credit_features', count(*), CAST(sum(customer_id) AS BIGINT) FROM gold_features
       UNION ALL SELECT 'customer_transactions', count(*), CAST(sum(customer_id) AS BIGINT) FROM silver_transactions
       WHERE transaction_date IS NULL
          OR transaction_date >= (SELECT CAST(max(score_generated_at) AS DATE) - 1095 FROM current_scores)""",
    name="publish_serving",
)
def publish_serving_tables(lake: Lake) -> DataFrame:
    root = fresh_path(lake.spark, "serving")
    paths = publish_serving(
        root,
        customers=lake.table("customers"),
        loans=lake.table("loans"),
        scores=lake.table("scores"),
        features=lake.table("features"),
        transactions=lake.table("transactions"),
    )
    result = None
    for name, path in paths.items():
        counted = lake.spark.read.parquet(path).agg(
            F.count(F.lit(1)).alias("row_count"), F.sum("customer_id").alias("id_sum")
        )
        counted = counted.select(F.lit(name).alias("table_name"), "row_count", "id_sum")
        result = counted if result is None else result.unionByName(counted)
    return result
