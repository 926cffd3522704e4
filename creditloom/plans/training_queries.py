"""Queries on training and model quality."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.functions.scoring import ScoringConfig
from creditloom.operators import boosting, training
from creditloom.operators.scores import score_customers
from creditloom.plans.lake import CONFIG, Lake, model_probability
from creditloom.plans.oracle import training_sql
from creditloom.plans.registry import query
from creditloom.schemas import FEATURE_COLUMNS
from creditloom.session import fresh_path
from creditloom.sources.files import save_scoring_config, scan_scoring_config


@query("SELECT default_flag, count(*) AS row_count FROM gold_features GROUP BY default_flag")
def label_guard(lake: Lake) -> DataFrame:
    training.require_two_classes(lake.table("features"))
    return training.label_counts(lake.table("features"))


@query("SELECT * FROM split")
def stratified_split(lake: Lake) -> DataFrame:
    rows = lake.table("features").select("customer_id", "default_flag")
    return training.stratified_split(rows)


@query(
    """SELECT default_flag, n AS row_count, sum(n) OVER () / (count(*) OVER () * n)::DOUBLE AS weight
       FROM (SELECT default_flag, count(*) AS n FROM gold_features GROUP BY default_flag)"""
)
def class_weights(lake: Lake) -> DataFrame:
    return training.class_weights(lake.table("features"))


@query()
def train_default_model(lake: Lake) -> DataFrame:
    return training.predict(lake.trained().model, lake.table("features")).select("customer_id", "raw_probability")


@query()
def platt_fit(lake: Lake) -> DataFrame:
    """Calibration and quality of the trained model on the held-out part, in one row."""
    trained = lake.trained()
    names = ["auc", "brier_raw", "brier_calibrated", "base_rate", "train_rows", "valid_rows"]
    row = (trained.config.intercept, trained.config.slope, *(float(trained.metrics[n]) for n in names))
    return lake.spark.createDataFrame([row], ", ".join(f"{n} double" for n in ["intercept", "slope", *names]))


def _training_rows(lake: Lake) -> DataFrame:
    """The training part; standard deviations to four digits, below which engines differ."""
    rows = lake.table("features").withColumn("account_stability", F.round("account_stability", 4))
    return training.stratified_split(rows.select("customer_id", *FEATURE_COLUMNS, training.LABEL)).where("is_train")


@query(training_sql.bins())
def feature_bins(lake: Lake) -> DataFrame:
    return boosting.bin_edges(_training_rows(lake), FEATURE_COLUMNS)


@query(training_sql.first_tree())
def first_tree_splits(lake: Lake) -> DataFrame:
    rows = training.with_class_weights(_training_rows(lake))
    found = boosting.first_tree(rows, FEATURE_COLUMNS, training.LABEL, "weight")
    return found.withColumn("gain", F.round("gain", 6))


@query(training_sql.PLATT)
def platt_newton(lake: Lake) -> DataFrame:
    """The calibration of the fixed model, on all customers."""
    scored = lake.table("features").select(training.LABEL, model_probability().alias("raw_probability"))
    fitted = training.platt_steps(scored)
    return scored.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.round(F.lit(fitted.intercept), 6).alias("intercept"),
        F.round(F.lit(fitted.slope), 6).alias("slope"),
        F.round(F.lit(fitted.steps[-1][2]), 6).alias("loss"),
        "row_count",
    )


@query()
def customer_credit_scores_trained(lake: Lake) -> DataFrame:
    trained = lake.trained()
    predicted = training.predict(trained.model, lake.table("features"))
    return score_customers(predicted, F.col("raw_probability"), trained.config, F.lit(lake.as_of).cast("timestamp"))


@query(
    """SELECT round(avg((greatest(1e-6, least(1 - 1e-6, r.raw_p)) - r.default_flag) ** 2), 9) AS brier_raw,
       round(avg((c.p - c.default_flag) ** 2), 9) AS brier_calibrated,
       round(avg(r.default_flag), 9) AS base_rate, count(*) AS row_count,
       round((SELECT sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) FROM (
           SELECT raw_p, pos, neg, coalesce(sum(neg) OVER (ORDER BY raw_p
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
           FROM (SELECT round(raw_p, 9) AS raw_p, count(*) FILTER (WHERE default_flag = 1) AS pos,
                        count(*) FILTER (WHERE default_flag = 0) AS neg FROM model_raw GROUP BY 1))), 9) AS auc
       FROM model_raw r JOIN model_calibrated c ON c.customer_id = r.customer_id"""
)
def model_metrics(lake: Lake) -> DataFrame:
    scored = lake.table("features").select("default_flag", F.round(model_probability(), 9).alias("raw_probability"))
    metrics = training.model_metrics(scored, CONFIG)
    return metrics.select("row_count", *[F.round(c, 9).alias(c) for c in metrics.columns if c != "row_count"])


@query(
    """SELECT avg(default_flag) AS base_default_rate, (1 - avg(default_flag)) / greatest(avg(default_flag), 1e-6)
           AS base_odds, 600.0::DOUBLE AS base_score, 20.0::DOUBLE AS points_to_double_odds, 300 AS min_score,
       850 AS max_score, 0.05::DOUBLE AS low_max, 0.15::DOUBLE AS medium_max FROM gold_features"""
)
def scorecard_params(lake: Lake) -> DataFrame:
    return training.scorecard_parameters(lake.table("features"))


_FULL = """('calibration', 'platt_logit'), ('intercept', '-2.3946103913682166'), ('slope', '1.1236752427476158'),
    ('scorecard', 'log_odds'), ('base_score', '600.0'), ('points_to_double_odds', '20.0'), ('min_score', '300'),
    ('max_score', '850'), ('low_max', '0.05'), ('medium_max', '0.15')"""
_DEFAULTS = """('calibration', NULL), ('intercept', '0.0'), ('slope', '1.0'), ('scorecard', NULL), ('base_score', '600.0'),
    ('points_to_double_odds', '20.0'), ('min_score', '300'), ('max_score', '850'), ('low_max', '0.2'), ('medium_max', '0.5')"""


@query(
    f"""SELECT 'full' AS document, field, text, try_cast(text AS DOUBLE) AS number FROM (VALUES {_FULL}) AS v(field, text)
    UNION ALL SELECT 'sparse', field, text, try_cast(text AS DOUBLE) FROM (VALUES {_DEFAULTS}) AS v(field, text)
    UNION ALL SELECT document, 'base_odds', NULL, round((1 - r) / greatest(r, 1e-6), 9)
        FROM (SELECT avg(default_flag) AS r FROM gold_features), (VALUES ('full'), ('sparse')) AS d(document)"""
)
def model_metadata(lake: Lake) -> DataFrame:
    """Fields of a complete metadata document and of one that holds the odds alone, as they are read back."""
    odds = training.scorecard_parameters(lake.table("features")).first()["base_odds"]
    documents = []
    for name, config in (("full", replace(CONFIG, base_odds=odds)), ("sparse", ScoringConfig(base_odds=odds))):
        path = fresh_path(lake.spark, "metadata")
        only = None if name == "full" else {"base_odds"}
        save_scoring_config(lake.spark, config, path, only=only)
        documents.append(scan_scoring_config(lake.spark, path).withColumn("document", F.lit(name)))
    rows = documents[0].unionByName(documents[1])
    plain = F.when(F.col("field") != "base_odds", F.col("text"))
    return rows.select("document", "field", plain.alias("text"), F.round("number", 9).alias("number"))
