"""Scoring every customer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions import scoring
from creditloom.functions.scoring import ScoringConfig


def model_probabilities(
    model: Transformer | PipelineModel, features: DataFrame, name: str = "raw_probability"
) -> DataFrame:
    """Probability of default from a fitted classifier, as a plain column."""
    scored = model.transform(features)
    added = [c for c in scored.columns if c not in features.columns]
    return scored.withColumn(name, vector_to_array("probability")[1]).drop(*[c for c in added if c != name])


def score_customers(
    features: DataFrame,
    raw_probability: Column,
    config: ScoringConfig,
    scored_at: Column,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One score row per feature row, with the columns of ``keep``; a narrow projection."""
    calibrated = features.select(
        "customer_id",
        "institution_id",
        "source_system",
        scoring.calibrate(raw_probability, config).alias("default_probability"),
        scored_at.alias("score_generated_at"),
        *keep,
    )
    probability = F.col("default_probability")
    return calibrated.select(
        "customer_id",
        "institution_id",
        "source_system",
        scoring.credit_score(probability, config).alias("credit_score"),
        "default_probability",
        scoring.risk_level(probability, config).alias("risk_level"),
        "score_generated_at",
        *keep,
    )
