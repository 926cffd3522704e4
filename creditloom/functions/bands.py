"""Named score scales. Each belongs to another view; they are not interchangeable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lowest score, label (and tone), best first.
INSIGHT_BANDS = [(760, "EXCELLENT"), (700, "GOOD"), (640, "FAIR")]
INSIGHT_LOWEST = "REBUILDING"
CONSUMER_BANDS = [
    (800, "Exceptional", "good"),
    (740, "Very Good", "good"),
    (670, "Good", "good"),
    (580, "Fair", "warning"),
]
CONSUMER_LOWEST = ("Needs Work", "danger")


def first_match(cases: list[tuple[Column, str]], otherwise: str) -> Column:
    expression = F
    for condition, value in cases:
        expression = expression.when(condition, F.lit(value))
    return expression.otherwise(F.lit(otherwise))


def insight_band(score: Column) -> Column:
    return first_match([(score >= low, label) for low, label in INSIGHT_BANDS], INSIGHT_LOWEST)


def consumer_band(score: Column) -> Column:
    return first_match([(score >= low, label) for low, label, _ in CONSUMER_BANDS], CONSUMER_LOWEST[0])


def consumer_tone(score: Column) -> Column:
    return first_match([(score >= low, tone) for low, _, tone in CONSUMER_BANDS], CONSUMER_LOWEST[1])
