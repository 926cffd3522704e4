"""Probability to calibrated probability, score and risk level, as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any, ClassVar

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6


@dataclass(frozen=True)
class ScoringConfig:
    """How raw model output becomes a score; the defaults apply where metadata is silent."""

    calibration: str | None = None
    intercept: float = 0.0
    slope: float = 1.0
    scorecard: str | None = None
    base_score: float = 600.0
    base_odds: float = 20.0
    points_to_double_odds: float = 20.0
    min_score: int = 300
    max_score: int = 850
    low_max: float = 0.20
    medium_max: float = 0.50

    # keys of the metadata document: section, key, field, type
    _KEYS: ClassVar = (
        ("probability_calibration", "method", "calibration", str),
        ("probability_calibration", "intercept", "intercept", float),
        ("probability_calibration", "coef", "slope", float),
        ("scorecard", "method", "scorecard", str),
        ("scorecard", "base_score", "base_score", float),
        ("scorecard", "base_odds", "base_odds", float),
        ("scorecard", "pdo", "points_to_double_odds", float),
        ("scorecard", "min_score", "min_score", int),
        ("scorecard", "max_score", "max_score", int),
        ("risk_bands", "low_max_default_probability", "low_max", float),
        ("risk_bands", "medium_max_default_probability", "medium_max", float),
    )

    @classmethod
    def from_metadata(cls, metadata: dict[str, Any]) -> ScoringConfig:
        found = {}
        for section, key, field, kind in cls._KEYS:
            value = (metadata.get(section) or {}).get(key)
            if value is not None:
                found[field] = kind(value)
        return cls(**found)

    @classmethod
    def keys(cls) -> list[tuple[str, str, str]]:
        """(section, key, field) of the metadata document."""
        return [(section, key, field) for section, key, field, _ in cls._KEYS]

    @classmethod
    def from_texts(cls, texts: dict[str, str | None]) -> ScoringConfig:
        kinds = {field: kind for _, _, field, kind in cls._KEYS}
        return cls(**{field: kinds[field](text) for field, text in texts.items() if text is not None})

    def to_metadata(self, only: set[str] | None = None) -> dict[str, Any]:
        metadata: dict[str, Any] = {}
        for section, key, field, _ in self._KEYS:
            if only is None or field in only:
                metadata.setdefault(section, {})[key] = getattr(self, field)
        return metadata


# The published model's calibration, scorecard and risk bands.
PUBLISHED = ScoringConfig(
    calibration="platt_logit",
    intercept=-2.3946103913682166,
    slope=1.1236752427476158,
    scorecard="log_odds",
    base_score=600.0,
    base_odds=11.650360581192938,
    points_to_double_odds=20.0,
    min_score=300,
    max_score=850,
    low_max=0.05,
    medium_max=0.15,
)


def clamp_probability(p: Column) -> Column:
    return F.greatest(F.lit(EPSILON), F.least(F.lit(1.0 - EPSILON), p.cast("double")))


def logit(p: Column) -> Column:
    inside = clamp_probability(p)
    return F.log(inside / (1.0 - inside))


def sigmoid(x: Column) -> Column:
    small = F.exp(-F.abs(x))  # never overflows
    return F.when(x >= 0, 1.0 / (1.0 + small)).otherwise(small / (1.0 + small))


def calibrate(raw: Column, config: ScoringConfig) -> Column:
    """Platt scaling on the logit, or the clamped input for any other method."""
    if config.calibration != "platt_logit":
        return clamp_probability(raw)
    return clamp_probability(sigmoid(config.intercept + config.slope * logit(raw)))


def _as_score(value: Column, config: ScoringConfig) -> Column:
    rounded = F.rint(value)  # half to even
    return F.greatest(F.lit(config.min_score), F.least(F.lit(config.max_score), rounded.cast("int")))


def log_odds_score(p: Column, config: ScoringConfig) -> Column:
    inside = clamp_probability(p)
    factor = config.points_to_double_odds / math.log(2.0)
    offset = config.base_score - factor * math.log(max(config.base_odds, EPSILON))
    return _as_score(offset + factor * F.log((1.0 - inside) / inside), config)


def linear_score(p: Column, config: ScoringConfig) -> Column:
    return _as_score(850.0 - clamp_probability(p) * 550.0, config)


def credit_score(p: Column, config: ScoringConfig) -> Column:
    return log_odds_score(p, config) if config.scorecard == "log_odds" else linear_score(p, config)


def risk_level(p: Column, config: ScoringConfig) -> Column:
    return F.when(p <= config.low_max, "LOW").when(p <= config.medium_max, "MEDIUM").otherwise("HIGH")


def linear_probability(weights: dict[str, float], intercept: float) -> Column:
    """Raw probability of a logistic model over feature columns."""
    total = F.lit(intercept)
    for name, weight in weights.items():
        total = total + weight * F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    return sigmoid(total)
