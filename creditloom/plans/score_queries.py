"""Queries on scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.functions import scoring
from creditloom.plans.lake import CONFIG, Lake, model_probability
from creditloom.plans.registry import query

# probabilities over the whole range, both ends included
_SPREAD = "(o_orderkey % 2001) / 2000"
_RAW_SQL = f"SELECT o_orderkey, {_SPREAD} AS raw_p FROM orders"
_CLAMPED = "greatest(1e-6, least(1 - 1e-6, raw_p))"


def _spread(lake: Lake) -> DataFrame:
    orders = lake.spark.read.parquet(f"{lake.sf_dir}/orders.parquet")
    return orders.select("o_orderkey", (F.col("o_orderkey") % 2001 / 2000).alias("raw_p"))


@query(
    f"""SELECT o_orderkey, round(greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-y)))), 9) AS calibrated,
               round({_CLAMPED}, 9) AS uncalibrated
        FROM (SELECT *, -2.3946103913682166::DOUBLE + 1.1236752427476158::DOUBLE
                     * ln({_CLAMPED} / (1 - {_CLAMPED})) AS y FROM ({_RAW_SQL}))"""
)
def calibrate_probability(lake: Lake) -> DataFrame:
    raw = F.col("raw_p")
    return _spread(lake).select(
        "o_orderkey",
        F.round(scoring.calibrate(raw, CONFIG), 9).alias("calibrated"),
        F.round(scoring.calibrate(raw, scoring.ScoringConfig()), 9).alias("uncalibrated"),
    )


@query(
    f"""SELECT o_orderkey, CAST(greatest(300, least(850, round_even(
               600 - 20 / ln(2.0) * ln(11.650360581192938::DOUBLE)
               + 20 / ln(2.0) * ln((1 - {_CLAMPED}) / {_CLAMPED}), 0))) AS INTEGER) AS credit_score
        FROM ({_RAW_SQL})"""
)
def log_odds_score(lake: Lake) -> DataFrame:
    return _spread(lake).select("o_orderkey", scoring.log_odds_score(F.col("raw_p"), CONFIG).alias("credit_score"))


@query(
    f"""SELECT o_orderkey, CAST(greatest(300, least(850, round_even(850 - {_CLAMPED} * 550, 0))) AS INTEGER)
        AS credit_score FROM ({_RAW_SQL})"""
)
def linear_score(lake: Lake) -> DataFrame:
    return _spread(lake).select("o_orderkey", scoring.linear_score(F.col("raw_p"), CONFIG).alias("credit_score"))


@query(
    f"""SELECT o_orderkey,
        CASE WHEN raw_p <= 0.05 THEN 'LOW' WHEN raw_p <= 0.15 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level,
        CASE WHEN raw_p <= 0.2 THEN 'LOW' WHEN raw_p <= 0.5 THEN 'MEDIUM' ELSE 'HIGH' END AS default_level
        FROM ({_RAW_SQL})"""
)
def risk_level(lake: Lake) -> DataFrame:
    raw = F.col("raw_p")
    return _spread(lake).select(
        "o_orderkey",
        scoring.risk_level(raw, CONFIG).alias("risk_level"),
        scoring.risk_level(raw, scoring.ScoringConfig()).alias("default_level"),
    )


@query("SELECT * REPLACE (round(default_probability, 9) AS default_probability) FROM current_scores")
def customer_credit_scores(lake: Lake) -> DataFrame:
    return lake.scores().withColumn("default_probability", F.round("default_probability", 9))


@query("SELECT customer_id, round(raw_p, 9) AS raw_probability FROM model_raw")
def raw_probability(lake: Lake) -> DataFrame:
    return lake.table("features").select("customer_id", F.round(model_probability(), 9).alias("raw_probability"))
